"""Queries over the corpus: cleaning, gate, statistics, duplicates, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zrno.functions import text as tx
from zrno.operators import dedup, gate, stats
from zrno.plans import merge
from zrno.plans.registry import query
from zrno.session import cut, spread, table

# The same expressions in SQL.
FOLD = "translate(replace(lower({x}), 'ß', 'ss'), 'ſς', 'sσ')"
WORDS = "list_filter(regexp_split_to_array({x}, '" + tx.WS + "+'), lambda w: w <> '')"
LINES = "list_filter(list_transform(string_split_regex({x}, '" + tx.LINE_BREAK + "'), lambda s: regexp_replace(regexp_replace(s, '^" + tx.WS + "+', ''), '" + tx.WS + "+$', '')), lambda s: s <> '')"
STOP = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(gate.STOPWORDS.split())) + "]"
MARKS = gate.MARKS.replace("'", "''")


def fold(x: str) -> str:
    return FOLD.replace("{x}", x)


def words(x: str) -> str:
    return WORDS.replace("{x}", x)


def lines(x: str) -> str:
    return LINES.replace("{x}", x)


def docs_of(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spread(table(spark, sf_dir, "corpus_docs").select(*cols))


TOKENS = f"regexp_extract_all({fold('text')}, '{tx.WORD}+')"
SHINGLES = f"""tok AS (SELECT rec_id, author, title, source, {TOKENS} AS t FROM corpus_docs WHERE text IS NOT NULL),
sh AS (SELECT rec_id, author, title, source, unnest(list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
  ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) END)) AS s FROM tok),
n AS (SELECT rec_id, count(*) AS n FROM sh GROUP BY 1)"""


@query(f"""SELECT rec_id, len(w) AS n_words, length(text) AS n_chars, strlen(text) AS n_bytes FROM (SELECT rec_id, text, {words('text')} AS w FROM corpus_docs WHERE text IS NOT NULL)""")
def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_of(spark, sf_dir, "rec_id", "text").where("text is not null")
    return d.select("rec_id", F.size(tx.words("text")).cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"))


SIGNALS = f"""s AS (SELECT rec_id, shard, text, {words("coalesce(text, '')")} AS w, {lines("coalesce(text, '')")} AS l, len(regexp_extract_all(coalesce(text, ''), '\\b1[5-9]\\d\\d\\b|\\b20\\d\\d\\b')) AS y FROM corpus_docs),
g AS (SELECT rec_id, shard, text, len(w) AS n_tokens, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda t: list_contains({STOP}, {fold(f"trim(t, '{MARKS}')")})))::DOUBLE / len(w) END AS stop,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE y::DOUBLE / len(w) END AS years, len(l) AS nl,
  len(list_filter(l, lambda s: length(s) < 60 AND NOT regexp_matches(s, '[,;:!?.]') AND NOT regexp_matches(s, '[«“"]$'))) AS ti, len(list_filter(l, lambda s: regexp_matches(s, '\\p{{Nd}}'))) AS di,
  len(list_filter(l, lambda s: len({words('s')}) <= 8)) AS sl FROM s),
v AS (SELECT *, CASE WHEN nl < 10 THEN false ELSE ti::DOUBLE / nl > 0.65 OR (di::DOUBLE / nl > 0.10 AND ti::DOUBLE / nl > 0.30) END AS idx FROM g)"""
VERDICT = "CASE WHEN n_tokens = 0 THEN 'empty' WHEN stop < 0.05 THEN 'not_slovene' WHEN years > 0.05 THEN 'bibliography' WHEN idx THEN 'index_list' ELSE 'kept' END"


@query(f"WITH {SIGNALS} SELECT rec_id, n_tokens, stop, years, idx AS index, {VERDICT} AS verdict FROM v")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = gate.signals(docs_of(spark, sf_dir, "rec_id", "text"))
    return d.select("rec_id", F.col("n_tokens").cast("long").alias("n_tokens"), "stop", "years", "index", "verdict")


@query(f"WITH {SIGNALS} SELECT rec_id, CASE WHEN nl = 0 THEN 0.0 ELSE sl::DOUBLE / nl END AS short_lines, CASE WHEN nl = 0 THEN false ELSE sl::DOUBLE / nl > 0.55 END AS verse FROM v")
def verse_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return docs_of(spark, sf_dir, "rec_id", "text").select("rec_id", gate.short_line_share(t).alias("short_lines"), gate.is_verse(t).alias("verse"))


@query("""SELECT rec_id, regexp_matches(title, '^(Abecedni )?[Ss]eznam ') AS index_title, regexp_matches(coalesce(text, ''), '(?i)^\\s*#(redirect|preusmeritev)') AS redirect, regexp_matches(coalesce(text, ''), '(?i)\\{\\{\\s*Razločitev|Kategorija:\\s*Razločitev') AS disambiguation FROM corpus_docs WHERE title IS NOT NULL""")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    d = docs_of(spark, sf_dir, "rec_id", "title", "text").where("title is not null")
    return d.select("rec_id", F.rlike("title", F.lit(gate.INDEX_TITLE)).alias("index_title"), F.rlike(t, F.lit(gate.REDIRECT)).alias("redirect"), F.rlike(t, F.lit(gate.DISAMBIGUATION)).alias("disambiguation"))


ALLOWED = stats.ALLOWED.replace("'", "''")
UNKNOWN = f"length(regexp_replace(translate(text, '{ALLOWED}', ''), '[\\s\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{001C}}-\\x{{001F}}]', '', 'g'))"
PROBES = {k: v.replace("'", "''") for k, v in stats.PROBES.items()}
METRICS = f"""m0 AS (SELECT source, text, list_transform({words('text')}, lambda w: {fold('w')}) AS w, {lines('text')} AS l FROM corpus_docs WHERE text IS NOT NULL AND source IS NOT NULL),
m AS (SELECT source, len(w) AS n_words, length(text) AS n_chars, {UNKNOWN} AS unknown, sha256(text) AS hash,
  CASE WHEN len(w) = 0 THEN 0.0 WHEN len(w) <= 500 THEN len(list_distinct(w))::DOUBLE / len(w)
    ELSE list_sum(list_transform(range(1, len(w) - 498, 100), lambda i: len(list_distinct(w[i:i+499])) / 500.0::DOUBLE)) / len(range(1, len(w) - 498, 100)) END AS mattr,
  CASE WHEN len(l) < 2 THEN 0.0 ELSE 1 - len(list_distinct(l))::DOUBLE / len(l) END AS dup_lines, {", ".join(f"regexp_matches(text, '{p}') AS {k}" for k, p in PROBES.items())} FROM m0)"""


@query(f"WITH {METRICS} SELECT source, sum(n_words)::BIGINT AS n_words, round(sum(mattr * n_words) / sum(n_words), 9) AS mattr, round(sum(dup_lines * n_words) / sum(n_words), 9) AS dup_line_frac, sum(unknown)::BIGINT AS unknown FROM m GROUP BY 1")
def lexical_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.document_metrics(docs_of(spark, sf_dir, "source", "text").where("source is not null"), keep=("source",))
    r = m.groupBy("source").agg(F.sum("n_words").alias("n_words"), (F.sum(F.col("mattr") * F.col("n_words")) / F.sum("n_words")).alias("mattr"), (F.sum(F.col("dup_lines") * F.col("n_words")) / F.sum("n_words")).alias("dup_line_frac"), F.sum("unknown").alias("unknown"))
    return r.withColumns({"mattr": F.round("mattr", 9), "dup_line_frac": F.round("dup_line_frac", 9)})


@query(f"""WITH {METRICS}, r AS (SELECT source, n_words, row_number() OVER (PARTITION BY source ORDER BY n_words) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM m),
p AS (SELECT source, min(n_words) AS words_p95 FROM r WHERE k = floor(0.95 * (n - 1))::BIGINT GROUP BY 1)
SELECT source, count(*) AS n_docs, sum(n_words)::BIGINT AS n_words, sum(n_chars)::BIGINT AS n_chars, min(n_words) AS words_min, median(n_words)::DOUBLE AS words_median, any_value(words_p95) AS words_p95, max(n_words) AS words_max,
  sum(unknown)::DOUBLE / sum(n_chars) AS unknown_char_rate, 1 - count(DISTINCT hash)::DOUBLE / count(*) AS exact_dup_rate, {", ".join(f"count(*) FILTER ({k})::DOUBLE / count(*) AS {k}" for k in PROBES)} FROM m JOIN p USING (source) GROUP BY source""")
def shard_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cut(stats.document_metrics(docs_of(spark, sf_dir, "source", "text").where("source is not null"), keep=("source",)), "metrics")
    return stats.shard_metrics(m, "source").drop("mattr", "dup_line_frac")


@query("""WITH o AS (SELECT rec_id, text, CASE WHEN shard = 'leksikon' THEN 3 WHEN shard LIKE 'dlib-%' AND shard LIKE '%-gapfill' THEN 2 WHEN shard LIKE 'dlib-%' THEN 1 ELSE 0 END AS tier, shard FROM corpus_docs WHERE text IS NOT NULL)
SELECT rec_id, sha256(text) AS hash, first_value(rec_id) OVER w AS root_id, row_number() OVER w = 1 AS is_first FROM o WINDOW w AS (PARTITION BY text ORDER BY tier, shard, rec_id)""")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = merge.prepared(docs_of(spark, sf_dir, "rec_id", "shard", "title", "url", "text", "source", "author"), merge.MergeParams()).where("text is not null")
    d = dedup.keep_first(d.select("rec_id", "tier", "shard", dedup.content_hash(F.col("text")).alias("hash")), "hash", ["tier", "shard", "rec_id"])
    return d.select("rec_id", "hash", F.col("root.rec_id").alias("root_id"), "is_first")


def sets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.shingle_sets(docs_of(spark, sf_dir, "rec_id", "author", "title", "source", "text").where("text is not null"), "rec_id", "text", keep=("author", "title", "source"))


@query(f"WITH {SHINGLES} SELECT tok.rec_id, len(t) AS n_tokens, coalesce(n, 0) AS n_shingles FROM tok LEFT JOIN n USING (rec_id)")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_of(spark, sf_dir, "rec_id", "text").where("text is not null")
    s = dedup.shingle_sets(d, "rec_id", "text")
    return d.select("rec_id", F.size(tx.tokens("text")).cast("long").alias("n_tokens")).join(s.select("rec_id", F.col("n").cast("long").alias("n_shingles")), "rec_id")


@query(f"""WITH {SHINGLES}, p AS (SELECT x.rec_id AS a, y.rec_id AS b, count(*) AS "both" FROM sh x JOIN sh y USING (s) WHERE x.rec_id < y.rec_id GROUP BY 1, 2)
SELECT a, b, "both", "both"::DOUBLE / (na.n + nb.n - "both") AS similarity FROM p JOIN n na ON na.rec_id = a JOIN n nb ON nb.rec_id = b WHERE "both"::DOUBLE / (na.n + nb.n - "both") >= 0.8""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.jaccard_pairs(sets_of(spark, sf_dir).select("rec_id", "sh", "n"), "rec_id", 0.8).withColumn("both", F.col("both").cast("long"))


@query(f"""WITH {SHINGLES}, p AS (SELECT x.rec_id AS a, y.rec_id AS b, x.author, count(*) AS "both" FROM sh x JOIN sh y USING (s, author) WHERE x.rec_id <> y.rec_id GROUP BY 1, 2, 3)
SELECT a, b, "both", "both"::DOUBLE / n.n AS containment FROM p JOIN n ON n.rec_id = a WHERE "both"::DOUBLE / n.n >= 0.5""")
def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sets_of(spark, sf_dir).where("author is not null").select("rec_id", "author", "sh", "n")
    return dedup.containment_pairs(s, "rec_id", 0.5, part=["author"]).withColumn("both", F.col("both").cast("long"))


@query(f"""WITH RECURSIVE {SHINGLES}, p AS (SELECT x.rec_id AS a, y.rec_id AS b, count(*) AS "both" FROM sh x JOIN sh y USING (s, author) WHERE x.rec_id <> y.rec_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n ON n.rec_id = a WHERE "both"::DOUBLE / n.n >= 0.5), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT rec_id AS a, rec_id AS c FROM tok UNION SELECT u.a, r.c FROM u JOIN r ON u.b = r.a WHERE r.c < u.a)
SELECT a AS rec_id, min(c) AS "cluster" FROM r GROUP BY 1""")
def doc_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sets_of(spark, sf_dir)
    pairs = dedup.containment_pairs(s.where("author is not null").select("rec_id", "author", "sh", "n"), "rec_id", 0.5, part=["author"])
    return dedup.cluster(pairs, s, "rec_id")


@query(f"""WITH {SHINGLES}, w AS (SELECT h.url, d.rec_id FROM holdout_works h JOIN corpus_docs d USING (url) WHERE text IS NOT NULL GROUP BY 1, 2), hs AS (SELECT DISTINCT w.rec_id AS h, s FROM w JOIN sh USING (rec_id)),
p AS (SELECT h, sh.rec_id AS b, count(*) AS "both" FROM hs JOIN sh USING (s) WHERE sh.rec_id <> h GROUP BY 1, 2)
SELECT w.rec_id, coalesce(max("both")::DOUBLE / any_value(n.n), 0.0) AS max_containment FROM w JOIN n USING (rec_id) LEFT JOIN p ON p.h = w.rec_id GROUP BY 1""")
def holdout_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each held-out page's texts stands in the one other record that holds most of it."""
    docs = docs_of(spark, sf_dir, "rec_id", "url", "text").where("text is not null")
    held = docs.join(table(spark, sf_dir, "holdout_works").select("url").distinct(), "url").select("rec_id").distinct()
    return dedup.most_contained(dedup.shingle_sets(docs, "rec_id", "text"), held, "rec_id")
