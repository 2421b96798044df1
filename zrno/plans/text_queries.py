"""Queries over titles, scanned lines, passages, responses and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zrno.functions import text as tx
from zrno.operators import cleaning, evaluation, gate, holdout, pairs
from zrno.plans.corpus_queries import docs_of, fold, words
from zrno.plans.registry import query
from zrno.session import cut, spread, table

W = tx.WS


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{W}+', ''), '{W}+$', '')"


def normal(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace({fold(x)}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '{W}+', ' ', 'g')")


SURNAME = f"{fold('list_extract(' + words('author') + ', -1)')}"
INNER = "regexp_extract(nfc_normalize(title), '\\(([^)]*)\\)\\s*$', 1)"
WITHOUT = f"CASE WHEN author IS NOT NULL AND {INNER} <> '' AND contains({fold(INNER)}, {SURNAME}) THEN regexp_replace(nfc_normalize(title), '\\s*\\([^)]*\\)\\s*$', '') ELSE nfc_normalize(title) END"


@query(f"""SELECT rec_id, {normal('nfc_normalize(title)')} AS title_key, {normal(WITHOUT)} AS work_key, regexp_replace(regexp_replace(strip_accents({normal('nfc_normalize(title)')}), '{W}+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM corpus_docs WHERE title IS NOT NULL""")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_of(spark, sf_dir, "rec_id", "title", "author").where("title is not null").withColumn("t", tx.nfc(F.col("title")))
    return d.select("rec_id", tx.normal_title(F.col("t")).alias("title_key"), tx.normal_title(tx.without_author(F.col("t"), F.col("author"))).alias("work_key"), tx.slug(F.col("t")).alias("slug"))


@query("""SELECT rec_id, nfc_normalize(text) = text AS is_nfc, coalesce(length(text) = n_chars, false) AS size_ok FROM corpus_docs WHERE text IS NOT NULL""")
def schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document keeps the schema's promises."""
    d = docs_of(spark, sf_dir, "rec_id", "text", "n_chars").where("text is not null")
    return d.select("rec_id", (tx.nfc(F.col("text")) == F.col("text")).alias("is_nfc"), F.coalesce(F.length("text") == F.col("n_chars"), F.lit(False)).alias("size_ok"))


LINE_Q = "CASE WHEN length({x}) = 0 THEN 1.0 ELSE 1 - length(regexp_replace({x}, '[\\p{L}\\s.,;:!?\\-\"''()„“”«»*…]', '', 'g'))::DOUBLE / length({x}) END"
SCAN = f"""t AS (SELECT rec_id, string_split(regexp_replace(regexp_replace(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), '�', ''), '([\\p{{L}}\\p{{N}}_])[-¬]\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '\\\\\\s+', ' ', 'g'), chr(10)) AS l FROM corpus_docs WHERE text IS NOT NULL),
e AS (SELECT rec_id, unnest(range(0, len(l))) AS i, regexp_replace({strip('unnest(l)')}, '[ \\t]+', ' ', 'g') AS s FROM t),
j AS (SELECT rec_id, i, s, length(s) > 0 AND (regexp_matches(s, '^\\s*-?\\s*\\d{{1,4}}\\s*-?\\s*$') OR regexp_matches(s, '^\\s*(Spisal|Napisal|Spisala|Napisala)\\b.{{0,60}}$') OR regexp_matches(s, '^\\\\+\\s*$')
  OR (i < 10 AND regexp_matches(s, '^\\s*(Štev\\.|V Ljubljani,? dne|Leposloven)|(\\bLeto [IVX]+\\.?\\s*$)')) OR (i < 30 AND length(s) <= 2 AND NOT regexp_matches(s, '^[IVXLC]{{1,6}}\\.?$')) OR {LINE_Q.replace('{x}', 's')} < 0.85) AS dropped FROM e),
k AS (SELECT rec_id, count(*) FILTER (dropped) AS dropped_lines, count(*) FILTER (NOT dropped AND length(s) > 0) AS kept_lines, coalesce({strip("regexp_replace(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT dropped), ''), '\\n{3,}', chr(10) || chr(10), 'g')")}, '') AS clean FROM j GROUP BY 1)"""


@query(f"""WITH {SCAN}, m AS (SELECT *, length(clean) AS n_chars, length(regexp_replace(clean, '[^\\p{{L}}\\s]', '', 'g')) AS alpha, length(regexp_replace(clean[1:1000], '[^<>^=~|%&$#]', '', 'g')) AS early_noise FROM k)
SELECT rec_id, dropped_lines, kept_lines, n_chars, alpha, early_noise, sha256(clean) AS hash, early_noise <= 10 AND alpha::DOUBLE / greatest(n_chars, 1) >= 0.84 AND n_chars >= 400 AS passed FROM m""")
def scan_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cleaning.clean_scan(docs_of(spark, sf_dir, "rec_id", "text").where("text is not null"), "text")
    return d.select("rec_id", *[F.col(c).cast("long").alias(c) for c in ("dropped_lines", "kept_lines", "n_chars", "alpha", "early_noise")], F.sha2("clean", 256).alias("hash"), "passed")


# Pages in wiki markup made of records, so that every rule of the cleaner and every reason of the filter has cases; the SQL says what must be left.
BODY = f"regexp_replace({strip("regexp_replace(nfc_normalize(text), '[ \\t]+\\n', chr(10), 'g')")}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
MARKUP = r"[\[\]{}<>|=^]|''|__|&(nbsp|lt|gt|quot|amp);"
PLAIN = f"""b AS (SELECT rec_id, coalesce(title, '') AS t0, CASE WHEN rec_id % 7 = 3 THEN regexp_replace({BODY}[1:150], '[ \\t]+$', '') ELSE {BODY} END AS body FROM corpus_docs WHERE text IS NOT NULL AND NOT regexp_matches(text, '{MARKUP.replace("'", "''")}')),
w AS (SELECT rec_id, t0, body, CASE rec_id % 11 WHEN 4 THEN 1 ELSE 0 END AS ns, rec_id % 13 IN (5, 6) AS redirect, CASE WHEN rec_id % 17 = 2 THEN 'Seznam del' ELSE t0 END AS title, rec_id % 19 = 1 AS disambiguation, rec_id % 23 = 0 AS bare FROM b),
x AS (SELECT *, CASE WHEN bare THEN '' ELSE {strip("regexp_replace('Naslov: glej oznako in Cilj ter krepko.' || chr(10) || chr(10) || body || chr(10) || 'konec', '\\n{3,}', chr(10) || chr(10), 'g')")} END AS clean FROM w)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, ns, title, text, redirected) of pages in wiki markup about records' texts that hold none themselves."""
    d = docs_of(spark, sf_dir, "rec_id", "title", "text").where("text is not null").where(~F.rlike("text", F.lit(MARKUP)))
    body = F.regexp_replace(tx.strip(F.regexp_replace(tx.nfc(F.col("text")), r"[ \t]+\n", "\n")), r"\n{3,}", "\n\n")
    k = lambda m, v: F.pmod("rec_id", F.lit(m)) == v
    d = d.withColumn("body", F.when(k(7, 3), F.substring(body, 1, 150)).otherwise(body))
    head = "Naslov:<ref name=\"a\">vir {{x}}</ref> {{Infopolje|a={{b|c}}}}glej [[Stran (prva)|oznako]] in [[Cilj]] ter '''krepko'''.<!-- skrito --><math>a|b</math>[[Slika:a.jpg|thumb|napis [[x]]]]\n{| class=\"t\"\n|-\n| celica {| b |}\n|}\n"
    tail = "\n<div>konec</div><ref/>__NOTOC__[[de:Titel]]\nKategorija:Proza\n^ opomba\n\n== Viri ==\n* nekaj {{odprto\n"
    redirect = F.when(k(13, 5), "#REDIRECT [[Drugam]]").when(k(13, 6), "#preusmeritev [[Drugam]]").otherwise("")
    text = F.when(k(23, 0), "{{Infopolje}}\n== Viri ==\nkonec").otherwise(F.concat(redirect, F.when(k(19, 1), "{{ Razločitev }}").otherwise(""), F.lit(head), F.lit("\n"), F.col("body"), F.lit(tail)))
    return d.select("rec_id", F.when(k(11, 4), 1).otherwise(0).alias("ns"), F.when(k(17, 2), "Seznam del").otherwise(F.coalesce("title", F.lit(""))).alias("title"), text.alias("text"), (redirect != "").alias("redirected"))


@query(f"WITH {PLAIN} SELECT rec_id, sha256(clean) AS hash, length(clean) AS n_chars FROM x WHERE NOT redirect")
def wiki_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cleaner leaves of pages with notes, templates, tables, links, media, magic words, categories, other wikis' links and back matter."""
    d = cut(_pages(spark, sf_dir).where("not redirected").select("rec_id", cleaning.dump_text(F.col("text")).alias("clean")), "clean")
    return d.select("rec_id", F.sha2("clean", 256).alias("hash"), F.length("clean").cast("long").alias("n_chars"))


@query(f"""WITH {PLAIN} SELECT CASE WHEN ns <> 0 THEN 'non_ns0' WHEN redirect AND NOT bare THEN 'redirect' WHEN regexp_matches(title, '^(Abecedni )?[Ss]eznam ') THEN 'list' WHEN disambiguation AND NOT bare THEN 'disambig' WHEN bare THEN 'empty' WHEN length(clean) < 400 THEN 'stub' ELSE 'document' END AS reason, count(*) AS n FROM x GROUP BY 1""")
def ingest_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter chain of a dump's ingestion, over pages in wiki markup."""
    d = cut(_pages(spark, sf_dir).withColumn("clean", cleaning.dump_text(F.col("text"))), "clean")
    return d.groupBy(F.coalesce(cleaning.ingest_reason(F.col("ns"), F.col("title"), F.col("text"), F.col("clean")), F.lit("document")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rec_id, regexp_replace(text, '([sS])oln([cčCČ])', '\\1on\\2', 'g') <> text AS changed, length(regexp_replace(text, '([sS])oln([cčCČ])', '\\1on\\2', 'g')) AS n_chars FROM corpus_docs WHERE text IS NOT NULL")
def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_of(spark, sf_dir, "rec_id", "text").where("text is not null").withColumn("s", evaluation.spelling(F.col("text")))
    return d.select("rec_id", (F.col("s") != F.col("text")).alias("changed"), F.length("s").cast("long").alias("n_chars"))


NAMED = "CASE WHEN rec_id % 9 = 4 THEN coalesce(title, '') || ' (' || (SELECT name FROM authors WHERE author_id = 1) || ')' ELSE coalesce(title, '') END"


@query(f"WITH t AS (SELECT rec_id, author, trim(regexp_extract({NAMED}, '\\(([^)]+)\\)\\s*$', 1)) AS named FROM corpus_docs) SELECT rec_id, named FROM t WHERE named <> '' AND named IN (SELECT name FROM authors) AND named IS DISTINCT FROM author")
def misattributed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose ending names another author of the roster, which has one row for each author and is fixed; to every ninth title the first author's name is added, so that there are cases."""
    names = table(spark, sf_dir, "authors").where("name is not null")
    roster = [r.name for r in names.select("name").distinct().collect()]
    first = F.lit((names.where("author_id = 1").select("name").first() or [""])[0])
    title = F.coalesce("title", F.lit(""))
    d = docs_of(spark, sf_dir, "rec_id", "title", "author").withColumn("title", F.when(F.pmod("rec_id", F.lit(9)) == 4, F.concat(title, F.lit(" ("), first, F.lit(")"))).otherwise(title))
    return d.select("rec_id", gate.by_other_author(F.col("title"), F.col("author"), F.array(*map(F.lit, roster))).alias("named")).where("named is not null")


@query("SELECT DISTINCT d.author, d.url FROM corpus_docs d JOIN (SELECT DISTINCT author, url FROM corpus_docs WHERE rec_id % 50 = 0 AND author IS NOT NULL AND url IS NOT NULL) w ON w.author = d.author AND w.url = d.url")
def misattributed_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a table of misattributed ones (every fiftieth record's stands in for it) that stand in the corpus under that author: what the guard names before it fails."""
    d = docs_of(spark, sf_dir, "rec_id", "author", "url")
    return holdout.misattributed(d, d.where("rec_id % 50 = 0").select("author", "url").where("author is not null"))


@query(f"SELECT rec_id, len(p) AS n_paragraphs, sha256(array_to_string(p, '|')) AS hash FROM (SELECT rec_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: regexp_replace(array_to_string({words('x')}, ' '), '^(?:[IVXL]{{1,6}}\\.|[IVXL]{{2,6}})\\s+([A-ZČŠŽ»„“])', '\\1')), lambda x: x <> '') AS p FROM corpus_docs WHERE text IS NOT NULL)")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_of(spark, sf_dir, "rec_id", "text").where("text is not null").select("rec_id", pairs.paragraphs(F.col("text")).alias("p"))
    return d.select("rec_id", F.size("p").cast("long").alias("n_paragraphs"), F.sha2(F.array_join("p", "|"), 256).alias("hash"))


# Sentences without looking around: every end is marked, then unmarked where no capital follows or an abbreviation or a number stands before it.
QUOTES = "[»«”“\"'']*"
MARKED = f"regexp_replace(regexp_replace({{p}}, '([.!?…]+{QUOTES}) ', '\\1' || chr(1), 'g'), chr(1) || '([^\\p{{Lu}}»„“\"''\\-–—(])', ' \\1', 'g')"
ABBR = "|".join(pairs.ABBREVIATIONS)
SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({MARKED}, '((?:^|[^\\p{{L}}\\p{{N}}_])(?:{ABBR}) {{0,3}}[.!?…]+{QUOTES})' || chr(1), '\\1 ', 'g'), '(\\p{{Nd}} {{0,3}}[.!?…]+{QUOTES})' || chr(1), '\\1 ', 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"
HEAD = "regexp_matches(p, '^(?:[IVXL]{1,6}\\.?|[A-ZČŠŽ][A-ZČŠŽ \\-]{3,})$')"
PARAGRAPHS = f"list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: regexp_replace(array_to_string({words('x')}, ' '), '^(?:[IVXL]{{1,6}}\\.|[IVXL]{{2,6}})\\s+([A-ZČŠŽ»„“])', '\\1')), lambda x: x <> '')"
ELIGIBLE = f"""gn AS (SELECT {normal('nfc_normalize(title)')} AS tk, min(genre) AS genre FROM documents WHERE title IS NOT NULL GROUP BY 1),
el AS (SELECT d.rec_id, CASE WHEN d.source IS DISTINCT FROM 'wikivir' OR d.author IS NULL THEN 'other_source' WHEN d.url IN (SELECT url FROM holdout_works WHERE url IS NOT NULL) THEN 'held_out' WHEN gn.genre IS NULL OR gn.genre NOT IN ('Proza', 'Pripovedni spisi', 'Esejistika', 'Mladinska dela') THEN 'not_prose' END AS skip FROM (SELECT *, {normal('nfc_normalize(title)')} AS tk FROM corpus_docs) d LEFT JOIN gn ON gn.tk = d.tk)"""
WINDOWS = f"""d AS (SELECT rec_id, {PARAGRAPHS} AS ps FROM corpus_docs WHERE source = 'wikivir' AND url IS NOT NULL AND text IS NOT NULL AND url NOT IN (SELECT url FROM holdout_works WHERE url IS NOT NULL)),
e AS (SELECT rec_id, unnest(range(0, len(ps))) AS para, unnest(ps) AS p FROM d),
f AS (SELECT rec_id, para, {HEAD} AS heading, CASE WHEN {HEAD} THEN [p] ELSE {SENTENCES.replace('{p}', 'p')} END AS s FROM e),
g AS (SELECT rec_id, para, heading, s, unnest(range(0, greatest(1, (len(s) + 5) // 6))) AS win FROM f),
h AS (SELECT rec_id, para, win, heading, s[win * 6 + 1:win * 6 + 6] AS x FROM g),
k AS (SELECT rec_id, para, win, array_to_string(x, ' ') AS text, len(x) AS n_sentences, length(array_to_string(x, ' ')) AS n_chars, win > 0 AS mid_paragraph, CASE WHEN heading THEN 'heading' WHEN len(x) < 2 THEN 'too_few_sentences' WHEN length(array_to_string(x, ' ')) < 120 THEN 'too_short' WHEN length(array_to_string(x, ' ')) > 800 THEN 'too_long' END AS r0 FROM h),
m AS (SELECT *, CASE WHEN r0 IS NULL THEN sha256(nfc_normalize(text))[1:16] END AS passage_id FROM k),
w AS (SELECT *, CASE WHEN r0 IS NULL AND row_number() OVER (PARTITION BY passage_id ORDER BY rec_id, para, win) > 1 THEN 'duplicate' ELSE r0 END AS reason FROM m)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_of(spark, sf_dir, "rec_id", "url", "title", "source", "text").where("source = 'wikivir' and url is not null")
    held = table(spark, sf_dir, "holdout_works").select("url").distinct()
    return pairs.windows(d.join(held, "url", "left_anti"), "rec_id", "text")


@query(f"WITH {WINDOWS} SELECT passage_id, rec_id, para, win, text, n_sentences, n_chars, mid_paragraph FROM w WHERE reason IS NULL")
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir).where("reason is null")
    long = lambda *cs: [F.col(c).cast("long").alias(c) for c in cs]
    return w.select("passage_id", "rec_id", *long("para", "win"), "text", *long("n_sentences", "n_chars"), "mid_paragraph")


@query(f"WITH {WINDOWS} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM w GROUP BY 1")
def passage_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate is accounted for."""
    return _windows(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ELIGIBLE} SELECT coalesce(skip, 'eligible') AS skip, count(*) AS n FROM el GROUP BY 1")
def passage_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why records give no passages to train on; genres come from the documents' titles."""
    g = table(spark, sf_dir, "documents").where("title is not null").select(tx.normal_title(tx.nfc(F.col("title"))).alias("tk"), "genre").groupBy("tk").agg(F.min("genre").alias("genre"))
    held = table(spark, sf_dir, "holdout_works").where("url is not null").select("url").distinct().withColumn("held", F.lit(True))
    d = docs_of(spark, sf_dir, "rec_id", "url", "title", "author", "source").withColumn("tk", tx.normal_title(tx.nfc(F.col("title"))))
    skip = pairs.skip_reason(F.col("source"), F.col("author"), F.coalesce("held", F.lit(False)), F.col("genre"), "wikivir")
    return d.join(held, "url", "left").join(g, "tk", "left").groupBy(F.coalesce(skip, F.lit("eligible")).alias("skip")).agg(F.count(F.lit(1)).alias("n"))


CARONS = "length(regexp_replace({x}, '[^čšžČŠŽ]', '', 'g'))"
ANOMALY = f"""a AS (SELECT pair_id, passage_id, coalesce(cankar, '') AS s, {strip("coalesce(plain, '')")} AS o FROM train_pairs),
f AS (SELECT *, list_distinct(regexp_extract_all(regexp_replace(o, '\\p{{Latin}}', '', 'g'), '\\p{{L}}')) AS fo, list_distinct(regexp_extract_all(regexp_replace(s, '\\p{{Latin}}', '', 'g'), '\\p{{L}}')) AS fs,
  length(o)::DOUBLE / nullif(length(s), 0) AS ratio, {CARONS.replace('{x}', 's')} AS cs, {CARONS.replace('{x}', 'o')} AS co FROM a),
z AS (SELECT *, regexp_matches(o, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:s\\s+[bdgzžvmnljraeiouáéíóú]|z\\s+[ptkfshcčšx])') AS mo, regexp_matches(s, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:s\\s+[bdgzžvmnljraeiouáéíóú]|z\\s+[ptkfshcčšx])') AS ms FROM f),
r AS (SELECT pair_id, passage_id, CASE WHEN o = '' THEN 'empty_output' WHEN starts_with(o, '#') OR starts_with(o, '```') OR starts_with(o, 'Here is') OR starts_with(o, 'Rewritten') OR starts_with(o, 'Translation:') OR starts_with(o, 'The passage') THEN 'not_a_rewrite'
  WHEN len(list_filter(fo, lambda c: NOT list_contains(fs, c))) > 0 THEN 'foreign_script' WHEN o = s THEN 'identity' WHEN ratio < 0.5 OR ratio > 1.8 THEN 'length_outlier' WHEN mo AND NOT ms THEN 'misassimilated' WHEN cs >= 8 AND co::DOUBLE / cs < 0.1 THEN 'lost_diacritics' END AS reason FROM z)"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "train_pairs").select("pair_id", "passage_id", "cankar", "plain"))
    return d.select("pair_id", "passage_id", pairs.anomaly(F.col("cankar"), F.col("plain")).alias("reason"))


@query(f"WITH {ANOMALY} SELECT pair_id, reason FROM r")
def response_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir).select("pair_id", "reason")


@query()
def response_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity to the source of responses without another anomaly; below 0.4 they diverge."""
    d = spread(table(spark, sf_dir, "train_pairs").select("pair_id", "cankar", "plain")).where(pairs.anomaly(F.col("cankar"), F.col("plain")).isNull())
    s = d.select("pair_id", pairs.similarity("cankar", "plain").alias("similarity"))
    return s.withColumn("divergent", F.col("similarity") < pairs.MIN_SIMILARITY)


@query(f"""WITH {ANOMALY}, g AS (SELECT passage_id, max(pair_id) FILTER (reason IS NULL) AS ok, min(pair_id) FILTER (reason IS NOT NULL) AS bad FROM r GROUP BY 1)
SELECT g.passage_id, coalesce(ok, bad) AS chosen, CASE WHEN ok IS NULL THEN r.reason END AS reason FROM g LEFT JOIN r ON r.pair_id = g.bad""")
def resolved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.resolve(_responses(spark, sf_dir), "passage_id", "pair_id", "reason")


@query(f"""WITH {ANOMALY}, known AS (SELECT DISTINCT passage_id FROM train_pairs WHERE pair_id % 3 <> 0 AND passage_id IS NOT NULL), z2 AS (SELECT r.* FROM r JOIN known USING (passage_id)), g AS (SELECT passage_id, max(pair_id) FILTER (reason IS NULL) AS ok, min(pair_id) FILTER (reason IS NOT NULL) AS bad FROM z2 GROUP BY 1)
SELECT g.passage_id, coalesce(ok, bad) AS chosen, CASE WHEN ok IS NULL THEN r.reason ELSE 'sound' END AS state FROM g LEFT JOIN r ON r.pair_id = g.bad UNION ALL SELECT passage_id, pair_id, 'unknown_passage' FROM r WHERE passage_id IS NULL OR passage_id NOT IN (SELECT passage_id FROM known)""")
def joined_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses joined with the passages that were sent (those of two in three pairs stand in for them): one row for each passage answered, one for each response to an unknown passage."""
    known = table(spark, sf_dir, "train_pairs").where("pair_id % 3 <> 0").select("passage_id").where("passage_id is not null").distinct()
    sent, strange = pairs.quarantined(_responses(spark, sf_dir), known, "passage_id")
    good = pairs.resolve(sent, "passage_id", "pair_id", "reason").select("passage_id", "chosen", F.coalesce("reason", F.lit("sound")).alias("state"))
    return good.union(strange.select("passage_id", "pair_id", F.lit("unknown_passage")))


RECEIPTS = "SELECT batch_id, last(created_at ORDER BY logged_at, downloaded, n_requests, model) AS created_at, last(downloaded ORDER BY logged_at, downloaded, n_requests, model) AS downloaded, last(n_requests ORDER BY logged_at, downloaded, n_requests, model) AS n_requests, min(logged_at) AS first_seen FROM batch_receipts WHERE batch_id IS NOT NULL GROUP BY 1"


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(table(spark, sf_dir, "batch_receipts"))


def _fold(log: DataFrame) -> DataFrame:
    f = pairs.fold_log(log, "batch_id", ["logged_at", "downloaded", "n_requests", "model"], ["created_at", "downloaded", "n_requests", "pair_set"])
    return f.withColumn("first_seen", F.col("first_seen.logged_at"))


@query(RECEIPTS)
def receipts_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _receipts(spark, sf_dir).drop("pair_set")


# The log as it stood at the median of its times: later batches are pending, unrecorded, and their passages still to come.
EARLY = "(SELECT * FROM batch_receipts WHERE logged_at <= (SELECT quantile_disc(logged_at, 0.5) FROM batch_receipts))"


def _early(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "batch_receipts")
    at = log.where("logged_at is not null").groupBy("logged_at").agg(F.count(F.lit(1)).alias("k"))
    order = Window.orderBy("logged_at")  # a row for each time of a small log
    upto = at.withColumns({"to": F.sum("k").over(order), "all": F.sum("k").over(Window.partitionBy())}).where(F.col("to") >= F.lit(0.5) * F.col("all")).agg(F.min("logged_at").alias("at"))
    return log.join(F.broadcast(upto), F.col("logged_at") <= F.col("at")).drop("at")


AT_LAST = "(SELECT * FROM batch_receipts WHERE logged_at <= (SELECT max(logged_at) FROM batch_receipts WHERE NOT downloaded))"


@query(f"SELECT batch_id, n_requests FROM ({RECEIPTS.replace('FROM batch_receipts', 'FROM ' + AT_LAST)}) WHERE NOT downloaded")
def pending_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches not yet downloaded when the last one was sent."""
    log = table(spark, sf_dir, "batch_receipts")
    last = log.where("not downloaded").agg(F.max("logged_at").alias("at"))
    return _fold(log.join(F.broadcast(last), F.col("logged_at") <= F.col("at")).drop("at")).where("not downloaded").select("batch_id", "n_requests")


@query(f"SELECT DISTINCT batch_id FROM train_pairs WHERE batch_id IS NOT NULL AND batch_id NOT IN (SELECT batch_id FROM {EARLY} WHERE batch_id IS NOT NULL)")
def unrecorded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of responses that half of the log does not know."""
    known = _early(spark, sf_dir).select("batch_id").distinct()
    return table(spark, sf_dir, "train_pairs").where("batch_id is not null").select("batch_id").distinct().join(known, "batch_id", "left_anti")


@query(f"SELECT DISTINCT passage_id FROM train_pairs WHERE passage_id NOT IN (SELECT passage_id FROM train_pairs p JOIN {EARLY} b USING (batch_id) WHERE b.downloaded AND passage_id IS NOT NULL) ORDER BY passage_id LIMIT 50")
def next_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 50 passages of which no batch that half of the log knows as downloaded has a response; a prefix that a longer one extends."""
    t = table(spark, sf_dir, "train_pairs")
    done = t.join(_early(spark, sf_dir).where("downloaded").select("batch_id").distinct(), "batch_id", "left_semi").select("passage_id")
    return pairs.next_passages(t.where("passage_id is not null").select("passage_id").distinct(), done, "passage_id", 50)


ARCHAIC = ["ter", "doklej", "zmerom", "vkup", "natihoma", "časih", "zgolj", "navsezgodaj", "vdrugič", "podvečer"]
SCORE = " + ".join(f"(list_contains({words('lower(cankar)')}, '{w}') AND NOT list_contains({words('lower(plain)')}, '{w}'))::INT" for w in ARCHAIC)


@query(f"SELECT pair_id, {SCORE} AS score FROM train_pairs WHERE cankar IS NOT NULL AND plain IS NOT NULL ORDER BY score DESC, pair_id LIMIT 12")
def best_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "train_pairs").where("cankar is not null and plain is not null")
    return pairs.best_samples(t, "pair_id", "cankar", "plain", ARCHAIC).select("pair_id", "score")


@query("SELECT sum(length(cankar))::BIGINT AS n_chars, count(*) AS n, floor(sum(length(cankar)) / 2.09 + count(*) * 300)::BIGINT AS in_tokens FROM train_pairs WHERE cankar IS NOT NULL")
def request_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "train_pairs").where("cankar is not null")
    return t.agg(F.sum(F.length("cankar")).alias("n_chars"), F.count(F.lit(1)).alias("n")).withColumn("in_tokens", F.floor(F.col("n_chars") / F.lit(2.09) + F.col("n") * 300).cast("long"))




FLAT = f"list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: regexp_replace(array_to_string({words('x')}, ' '), '^(?:[IVXL]{{1,6}}\\.|[IVXL]{{2,6}})\\s+([A-ZČŠŽ»„“])', '\\1')), lambda x: length(x) BETWEEN 120 AND 800)"


@query(f"SELECT rec_id, sha256(p[1]) AS hash FROM (SELECT rec_id, {FLAT} AS p FROM corpus_docs WHERE text IS NOT NULL AND source = 'leksikon') WHERE len(p) > 0 ORDER BY sha256(rec_id::VARCHAR) LIMIT 100")
def wild_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 paragraphs of general texts, in the order of a hash."""
    d = docs_of(spark, sf_dir, "rec_id", "text", "source").where("source = 'leksikon'")
    p = pairs.first_paragraphs(d, "rec_id", "text")
    return p.orderBy(F.sha2(F.col("rec_id").cast("string"), 256)).limit(100).select("rec_id", F.sha2("paragraph", 256).alias("hash"))
