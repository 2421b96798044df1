"""Queries over a works ledger made of the corpus and the library's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zrno.functions import encoding
from zrno.functions import text as tx
from zrno.operators import holdout, ledger
from zrno.plans.corpus_queries import docs_of, fold, words
from zrno.plans.registry import query
from zrno.plans.text_queries import WITHOUT, normal
from zrno.session import cut, table

KEY = normal(WITHOUT)
SLUG = f"regexp_replace(regexp_replace(strip_accents({KEY}), '{tx.WS}+', '-', 'g'), '^-+|-+$', '', 'g')"
WORKS = f"""k AS (SELECT author, title, url, source, {KEY} AS k, {SLUG} AS work_id FROM corpus_docs WHERE author IS NOT NULL AND title IS NOT NULL AND len({words('author')}) > 0),
w AS (SELECT author, k, min(work_id) AS work_id, min(title) AS title, count(*) AS n_records FROM k WHERE k <> '' GROUP BY 1, 2)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_of(spark, sf_dir, "rec_id", "author", "title", "url", "source").where("author is not null and title is not null").where(F.size(tx.words("author")) > 0)
    return d.withColumn("k", ledger.title_key(F.col("title"), F.col("author"))).where("k <> ''")


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "work_id string, author string, title string, year int, genre string, flags array<string>")
    e = _records(spark, sf_dir).select("author", "title", F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("genre"), F.array().cast("array<string>").alias("flags"))
    return ledger.upsert(none, e)


@query(f"WITH {WORKS} SELECT author, work_id, title FROM w")
def works_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as the corpus seeds it."""
    return _works(spark, sf_dir).select("author", "work_id", "title")


REFS = f"""r AS (SELECT author, k, 'archive' AS source, url AS id, 'ingested' AS status FROM k WHERE url IS NOT NULL AND source = 'wikivir' UNION ALL SELECT author, k, 'dlib', url, 'ingested' FROM k WHERE url IS NOT NULL AND source = 'dlib' UNION ALL SELECT author, k, 'encyclopedia', url, 'candidate' FROM k WHERE url IS NOT NULL AND source = 'leksikon')"""


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("source") == "wikivir", "archive").when(F.col("source") == "dlib", "dlib").otherwise("encyclopedia")
    d = _records(spark, sf_dir).where("url is not null").select("author", F.col("k").alias("work_id"), name.alias("source"), F.col("url").alias("id"), F.when(F.col("source") == "leksikon", "candidate").otherwise("ingested").alias("status"), F.lit(None).cast("int").alias("year"), F.lit("").alias("note"), F.col("rec_id").alias("seq"))
    none = spark.createDataFrame([], "author string, work_id string, source string, id string, status string, year int, note string")
    return ledger.add_sources(none, d)


@query(f"""WITH {WORKS}, {REFS}, s AS (SELECT w.author, w.k, list_sort(list_distinct(list(source) FILTER (status = 'ingested'))) AS got, count(*) FILTER (status = 'candidate') AS cand FROM w LEFT JOIN r ON r.author = w.author AND r.k = w.k GROUP BY 1, 2)
SELECT CASE WHEN len(coalesce(got, [])) > 0 THEN 'ingested (' || array_to_string(got, '+') || ')' WHEN cand > 0 THEN 'candidate' ELSE 'missing' END AS status, count(*) AS n_works FROM s GROUP BY 1""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _records(spark, sf_dir).select("author", F.col("k").alias("work_id")).distinct()
    refs = _refs(spark, sf_dir).groupBy("author", "work_id").agg(F.collect_list(F.struct("source", "id", "status")).alias("refs"))
    none = F.array().cast("array<struct<source:string,id:string,status:string>>")
    return w.join(refs, ["author", "work_id"], "left").select(ledger.status(F.coalesce("refs", none), F.array().cast("array<string>")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n_works"))


@query(f"""WITH d AS (SELECT DISTINCT author, {normal('nfc_normalize(title)')} AS title_key FROM corpus_docs WHERE author IS NOT NULL AND title IS NOT NULL) SELECT title_key, count(*) AS n_authors, array_to_string(list_sort(list(author)), '|') AS authors FROM d WHERE title_key <> '' GROUP BY 1 HAVING count(*) > 1""")
def title_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ledger.collisions(docs_of(spark, sf_dir, "author", "title").where("title is not null"))
    return c.withColumn("authors", F.array_join("authors", "|"))


@query(f"""WITH t AS (SELECT DISTINCT author, urn, title, year FROM (SELECT urn, title, year, unnest(people) AS p FROM edm_records) JOIN (SELECT name AS author, regexp_extract(name, '(\\S+)$', 1) || ', ' || regexp_extract(name, '^(\\S+)', 1) AS q FROM authors) ON p = q WHERE year IS NOT NULL AND title IS NOT NULL), k AS (SELECT *, {KEY} AS k, {SLUG} AS id FROM t)
SELECT DISTINCT author, urn, 'year' AS problem FROM k WHERE year < 1850 OR year > 1920 UNION ALL SELECT DISTINCT author, urn, 'id' FROM k WHERE id <> urn UNION ALL SELECT DISTINCT k.author, urn, 'title' FROM k JOIN (SELECT author, k FROM k GROUP BY 1, 2 HAVING count(*) > 1) d ON d.author = k.author AND d.k = k.k""")
def ledger_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with library records as works of roster authors: their number is no slug, the year is outside 1850 to 1920, the title repeats."""
    a = table(spark, sf_dir, "authors").select(F.col("name").alias("author"), F.concat(F.regexp_extract("name", r"(\S+)$", 1), F.lit(", "), F.regexp_extract("name", r"^(\S+)", 1)).alias("p"))
    e = table(spark, sf_dir, "edm_records").where("year is not null and title is not null").select("urn", "title", "year", F.explode("people").alias("p"))
    w = e.join(a, "p").select("author", F.col("urn").alias("work_id"), "title", "year").distinct()
    return ledger.violations(w, 1850, 1920).select("author", F.col("work_id").alias("urn"), "problem").distinct()


@query(f"""WITH {WORKS}, al AS (SELECT k.author, w.work_id, k.title, min(k.rec_id) AS seq FROM (SELECT rec_id, author, title, {KEY} AS k FROM corpus_docs WHERE author IS NOT NULL AND title IS NOT NULL AND len({words('author')}) > 0) k JOIN w ON w.author = k.author AND w.k = k.k WHERE k.title <> w.title GROUP BY 1, 2, 3),
u AS (SELECT author, work_id, title, 0 AS o, 0::BIGINT AS seq FROM w UNION ALL SELECT author, work_id, title, 1, seq FROM al), n AS (SELECT *, {normal('nfc_normalize(title)')} AS title_key FROM u)
SELECT author, title_key, first(work_id ORDER BY o, seq, work_id) AS work_id FROM n WHERE title_key <> '' GROUP BY 1, 2""")
def ledger_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of titles after every other spelling of a work's title is added as an alias: the first owner of a key keeps it."""
    w = cut(_works(spark, sf_dir).select("author", "work_id", "title", F.array().cast("array<string>").alias("aliases")), "works")
    keyed = w.withColumn("k", ledger.title_key(F.col("title"), F.col("author"))).select("author", "k", "work_id", F.col("title").alias("own"))
    new = _records(spark, sf_dir).join(keyed, ["author", "k"]).where("title <> own").groupBy("author", "work_id", F.col("title").alias("alias")).agg(F.min("rec_id").alias("seq"))
    return ledger.add_aliases(w, new)[1]


@query(f"""WITH {WORKS}, a AS (SELECT DISTINCT author, k, source FROM k WHERE k <> '') SELECT author, count(DISTINCT k) FILTER (NOT old) AS n_added, count(DISTINCT k) FILTER (old AND lib) AS n_updated FROM (SELECT author, k, bool_or(coalesce(source = 'wikivir', false)) AS old, bool_or(coalesce(source = 'dlib', false)) AS lib FROM a GROUP BY 1, 2) GROUP BY 1""")
def ledger_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by author that seeding from all records adds to a ledger of the archive's, and those whose genre the library's fill."""
    entry = lambda d: d.select("author", "title", F.lit(None).cast("int").alias("year"), F.when(F.col("source") == "dlib", "Proza").alias("genre"), F.array().cast("array<string>").alias("flags"))
    none = spark.createDataFrame([], "work_id string, author string, title string, year int, genre string, flags array<string>")
    r = _records(spark, sf_dir)
    before = cut(ledger.upsert(none, entry(r.where("source = 'wikivir'"))), "ledger")
    return ledger.seed_counts(before, ledger.upsert(before, entry(r)))


QUERY_NAME = "regexp_extract(name, '(\\S+)$', 1) || ', ' || regexp_extract(name, '^(\\S+)', 1)"
BY = f"""a AS (SELECT name, {QUERY_NAME} AS q FROM authors WHERE author_id = 1), e AS (SELECT DISTINCT urn, title, types, langs, people, creators, rights, text_url, harvested_at FROM edm_records),
b AS (SELECT e.*, a.name, CASE WHEN len(coalesce(creators, [])) > 0 THEN len(list_filter(creators, lambda c: starts_with({fold('c')}, {fold('q')}))) > 0
  ELSE len(list_filter(coalesce(people, []), lambda c: contains({fold('c')}, {fold("split_part(q, ',', 1)")}))) > 0 AND NOT (regexp_matches(coalesce(title, ''), '(?i)(napisal|spisal|zložil)') AND NOT contains({fold("regexp_extract(coalesce(title, ''), '(?i)(napisal|spisal|zložil)(.*)$', 2)")}, {fold("split_part(q, ',', 1)")}))
    AND NOT regexp_matches(coalesce(title, ''), '(?i)^spominu\\b|\\bv spomin\\b') END AS mine FROM e, a)"""


def _edm(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "authors").where("author_id = 1").select("name").first()
    name = a[0] if a else ""
    q = F.lit(f"{name.split()[-1]}, {name.split()[0]}" if name else "")
    e = table(spark, sf_dir, "edm_records").select("urn", "title", "types", "langs", "people", "creators", "rights", "text_url", "harvested_at").distinct()
    return e.withColumns({"name": F.lit(name), "mine": ledger.by_author(F.col("creators"), F.col("people"), F.col("title"), q)})


@query(f"WITH {BY} SELECT urn, harvested_at, mine FROM b")
def edm_authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edm(spark, sf_dir).select("urn", "harvested_at", "mine")


PARTS = f"""p AS (SELECT urn, name AS author, unnest(list_concat([title], list_filter(string_split_regex(title, '\\s*[:;|]\\s*'), lambda x: x <> ''))) AS title, unnest(range(0, 1 + len(list_filter(string_split_regex(title, '\\s*[:;|]\\s*'), lambda x: x <> '')))) AS pos FROM (SELECT DISTINCT urn, title, name FROM b WHERE title IS NOT NULL)),
q AS (SELECT urn, pos, author, {KEY} AS k FROM p), m AS (SELECT urn, first(w.work_id ORDER BY pos, w.work_id) AS work_id FROM q JOIN w ON w.author = q.author AND w.k = q.k GROUP BY 1)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edm(spark, sf_dir)
    return ledger.match_titles(e.select("urn", "title", F.col("name").alias("author")).distinct(), "urn", "title", "author", _works(spark, sf_dir))


@query(f"WITH {WORKS}, {BY}, {PARTS} SELECT urn, work_id FROM m")
def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)


@query(f"""WITH {WORKS}, {BY}, {PARTS}, x AS (SELECT DISTINCT e.urn, e.year, m.work_id FROM edm_records e JOIN m USING (urn)) SELECT work_id, first(urn ORDER BY year IS NULL, year, urn) AS urn, count(*) AS n_editions FROM x GROUP BY 1""")
def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library record to pull of each work that one matches."""
    e = table(spark, sf_dir, "edm_records").select("urn", "year").join(_matched(spark, sf_dir), "urn").distinct()
    return ledger.one_edition(e, "urn", "work_id")


@query(f"""WITH {WORKS}, {BY}, {PARTS}, u AS (SELECT DISTINCT upper(regexp_extract(url, '(?i)(urn:[a-z0-9:]+-[a-z0-9]+)', 1)) AS urn FROM corpus_docs WHERE url IS NOT NULL),
c AS (SELECT DISTINCT k.work_id FROM k, a WHERE k.author = a.name AND k.source = 'wikivir'),
x AS (SELECT b.*, m.work_id, u.urn IS NOT NULL AS own, c.work_id IS NOT NULL AS cov FROM b LEFT JOIN m ON m.urn = b.urn LEFT JOIN u ON u.urn = upper(b.urn) LEFT JOIN c ON c.work_id = m.work_id)
SELECT CASE WHEN NOT coalesce(mine, false) THEN 'not_author' WHEN len(list_filter(coalesce(types, []), lambda t: lower(t) IN ('rokopis', 'rokopisi'))) > 0 THEN 'manuscript' WHEN len(coalesce(langs, [])) > 0 AND NOT list_contains(list_transform(langs, lambda t: lower(t)), 'slv') THEN 'not_slovene'
  WHEN NOT contains(coalesce(rights, ''), '/pd/') THEN 'in_copyright' WHEN text_url IS NULL THEN 'pd_no_text' WHEN work_id IS NULL THEN 'pd_unmatched' WHEN own THEN 'pd_ingested' WHEN cov THEN 'pd_covered' ELSE 'pd_unpulled' END AS bucket, count(*) AS n FROM x GROUP BY 1""")
def edm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the library's records, as to the roster's first author."""
    e = _edm(spark, sf_dir)
    urls = docs_of(spark, sf_dir, "url").where("url is not null").select(F.upper(F.regexp_extract("url", r"(?i)(urn:[a-z0-9:]+-[a-z0-9]+)", 1)).alias("u")).distinct().withColumn("own", F.lit(True))
    w = _works(spark, sf_dir).select("author", "work_id", "title")
    covered = _records(spark, sf_dir).where("source = 'wikivir'").join(table(spark, sf_dir, "authors").where("author_id = 1").select(F.col("name").alias("author")), "author").select(tx.slug(F.col("k")).alias("work_id")).distinct().withColumn("cov", F.lit(True))
    m = cut(ledger.match_titles(e.select("urn", "title", F.col("name").alias("author")).distinct(), "urn", "title", "author", w), "matched")
    j = e.join(m, "urn", "left").withColumn("u", F.upper("urn")).join(urls, "u", "left").join(covered, "work_id", "left")
    no = F.lit(False)
    b = ledger.bucket(F.col("mine"), F.col("types"), F.col("langs"), F.col("rights"), F.col("text_url"), F.col("work_id"), F.coalesce("own", no), F.coalesce("cov", no))
    return j.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT h.url, CASE WHEN max(d.h) IS NULL THEN 'missing' WHEN max((d.h = h.content_sha256)::INT) = 1 THEN 'ok' ELSE 'drifted' END AS state FROM (SELECT DISTINCT url, content_sha256 FROM holdout_works) h LEFT JOIN (SELECT url, sha256(text) AS h FROM corpus_docs WHERE url IS NOT NULL AND text IS NOT NULL) d USING (url) GROUP BY 1""")
def holdout_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.verify(table(spark, sf_dir, "holdout_works"), docs_of(spark, sf_dir, "url", "text"))


@query("SELECT rec_id FROM corpus_docs WHERE url IS NULL OR url NOT IN (SELECT url FROM holdout_works WHERE url IS NOT NULL)")
def train_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.without(docs_of(spark, sf_dir, "rec_id", "url"), "url", table(spark, sf_dir, "holdout_works")).select("rec_id")


SIZES = f"""tok AS (SELECT rec_id, url, source, length(text) AS size, regexp_extract_all({fold('text')}, '{tx.WORD}+') AS t FROM corpus_docs WHERE text IS NOT NULL AND author = (SELECT name FROM authors WHERE author_id = 1)),
sh AS (SELECT rec_id, unnest(list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) END)) AS s FROM tok),
n AS (SELECT rec_id, count(*) AS n FROM sh GROUP BY 1), p AS (SELECT x.rec_id AS a, y.rec_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.rec_id <> y.rec_id GROUP BY 1, 2),
f AS (SELECT a, b, c::DOUBLE / n.n AS f FROM p JOIN n ON n.rec_id = a WHERE c::DOUBLE / n.n >= 0.5), best AS (SELECT a AS rec_id, max(f) AS most FROM f GROUP BY 1),
d AS (SELECT tok.rec_id, url, size, most, source = 'wikivir' AND size BETWEEN 1000 AND 45000 AS cand FROM tok LEFT JOIN best USING (rec_id)),
cl AS (SELECT *, coalesce(sum(size) OVER (ORDER BY sha256(url), rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY sha256(url), rec_id) AS rk FROM d WHERE cand AND most IS NULL AND url IS NOT NULL),
held AS (SELECT rec_id FROM cl WHERE before < (SELECT floor(0.05 * sum(size)) FROM tok) OR rk <= 8), cont AS (SELECT DISTINCT f.a AS rec_id FROM f JOIN held ON held.rec_id = f.b WHERE f.a NOT IN (SELECT rec_id FROM held))"""


@query(f"""WITH {SIZES} SELECT rec_id, url, role, max_containment FROM (SELECT d.rec_id, url, CASE WHEN held.rec_id IS NOT NULL THEN 'held_out' WHEN cont.rec_id IS NOT NULL THEN 'contained' WHEN cand AND most IS NOT NULL THEN 'rejected' WHEN cand THEN 'clean' END AS role, coalesce(most, 0.0) AS max_containment
FROM d LEFT JOIN held ON held.rec_id = d.rec_id LEFT JOIN cont ON cont.rec_id = d.rec_id) WHERE role IS NOT NULL""")
def holdout_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of the roster's first author, held out by characters."""
    who = table(spark, sf_dir, "authors").where("author_id = 1").select(F.col("name").alias("author"))
    d = docs_of(spark, sf_dir, "rec_id", "url", "text", "source", "author").join(who, "author", "left_semi").where("text is not null").withColumn("size", F.length("text").cast("long"))
    cand = (F.col("source") == "wikivir") & F.col("size").between(1000, 45000)
    r = holdout.select(d.select(F.col("rec_id").alias("key"), "url", "text", "size", "source"), cand, holdout.HoldoutParams(min_chars=1000))
    return r.withColumnRenamed("key", "rec_id")


@query()
def holdout_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of the roster's first author, held out by tokens, in the default band of lengths; enough tells whether the least number of works is reached."""
    who = table(spark, sf_dir, "authors").where("author_id = 1").select(F.col("name").alias("author"))
    d = docs_of(spark, sf_dir, "rec_id", "url", "text", "source", "author").join(who, "author", "left_semi").where("text is not null")
    n = encoding.count_tokens(d.withColumn("body", F.col("text")), "rec_id", "body", keep=("url", "source", "text"))
    p = holdout.HoldoutParams()
    cand = (F.col("source") == "wikivir") & F.length("text").between(p.min_chars, p.max_chars)
    r = cut(holdout.select(cut(n.select(F.col("rec_id").alias("key"), "url", "text", F.col("n_tokens").alias("size"), "source"), "sizes"), cand, p), "selected")
    k = r.agg((F.count(F.when(F.col("role") == "held_out", 1)) >= p.least_works).alias("enough"))
    return r.join(F.broadcast(k)).withColumnRenamed("key", "rec_id")
