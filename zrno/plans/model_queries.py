"""Queries over token counts, chunks, metrics and batches."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zrno.functions import encoding
from zrno.functions import text as tx
from zrno.operators import chunking, dedup, evaluation, gate, holdout, training
from zrno.operators.components import numbered
from zrno.plans.corpus_queries import docs_of, fold, words
from zrno.plans.registry import query
from zrno.plans.text_queries import ARCHAIC, RECEIPTS
from zrno.session import cut, shared_dir, spread, table
from zrno.streaming import incremental


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.count_tokens(docs_of(spark, sf_dir, "rec_id", "source", "author", "text").where("text is not null"), "rec_id", "text", keep=("source", "author"))


def training_records(d: DataFrame, works: DataFrame, same: DataFrame | None) -> DataFrame:
    """Records that are trained on: without held-out pages and, where given, the records contained in them."""
    d = holdout.without(d, "url", works)
    return d if same is None else d.join(same, "rec_id", "left_anti")


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, text) of what is trained on: every record with text, but for held-out pages and records contained in them. The held-out works must be frozen on this corpus."""
    works = table(spark, sf_dir, "holdout_works")
    d = docs_of(spark, sf_dir, "rec_id", "url", "author", "text").where("text is not null")
    same = cut(holdout.contained(d.withColumnRenamed("rec_id", "key"), works).withColumnRenamed("key", "rec_id"), "contained")  # of known size, so that few are broadcast
    return training_records(d, works, same).select("rec_id", "text")


@query()
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.token_totals(_sizes(spark, sf_dir), "source", "author")


def _first_author(spark: SparkSession, sf_dir: str) -> str:
    return (table(spark, sf_dir, "authors").where("author_id = 1").select("name").first() or [""])[0]


@query()
def token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens a word, bytes a token, digit tokens and odd characters, by slice."""
    d = docs_of(spark, sf_dir, "rec_id", "source", "author", "text").where("text is not null")
    d = d.select("rec_id", chunking.slice_of(F.col("source"), F.col("author"), _first_author(spark, sf_dir), "leksikon").alias("slice"), "text", F.col("text").alias("body"))
    return chunking.fertility(encoding.count_tokens(d, "rec_id", "text", keep=("slice", "body"), digits=True), "slice", "body")


@query("""SELECT CASE WHEN author IS NOT DISTINCT FROM (SELECT name FROM authors WHERE author_id = 1) THEN 'first_author' WHEN source IS NOT DISTINCT FROM 'leksikon' THEN 'general' ELSE 'literary' END AS slice, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM corpus_docs WHERE text IS NOT NULL GROUP BY 1""")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_of(spark, sf_dir, "source", "author", "text").where("text is not null")
    g = d.groupBy(chunking.slice_of(F.col("source"), F.col("author"), _first_author(spark, sf_dir), "leksikon").alias("slice"))
    return g.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text").cast("long")).alias("n_chars"))


@query(f"""WITH m AS (SELECT CASE WHEN source IS NOT DISTINCT FROM 'leksikon' THEN 'general' ELSE 'literary' END AS slice, length(text) AS nt, strlen(text) AS nb, len({words('text')}) AS nw, len(regexp_extract_all(text, '[0-9]')) AS nd, contains(text, chr(173)) AS soft, contains(text, chr(9)) AS tab FROM corpus_docs WHERE text IS NOT NULL),
r AS (SELECT slice, round(nt / nw::DOUBLE, 6) AS f, row_number() OVER (PARTITION BY slice ORDER BY round(nt / nw::DOUBLE, 6)) - 1 AS k, count(*) OVER (PARTITION BY slice) AS n FROM m WHERE nw > 0), q AS (SELECT slice, min(f) AS fertility_p95 FROM r WHERE k = floor(0.95 * (n - 1))::BIGINT GROUP BY 1)
SELECT slice, count(*) AS n_docs, sum(nw)::BIGINT AS n_words, sum(nb)::BIGINT AS n_bytes, sum(nt)::BIGINT AS n_tokens, sum(nd)::BIGINT AS n_digit_tokens, round(sum(nt) / sum(nw)::DOUBLE, 9) AS tokens_per_word, round(sum(nb) / sum(nt)::DOUBLE, 9) AS bytes_per_token, round(sum(nd) / sum(nt)::DOUBLE, 9) AS digit_token_share, any_value(fertility_p95) AS fertility_p95, count(*) FILTER (soft) AS soft_hyphens, count(*) FILTER (tab) AS tabs FROM m JOIN q USING (slice) GROUP BY 1""")
def character_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of token_fertility with characters as tokens, which SQL can count too."""
    d = docs_of(spark, sf_dir, "source", "text").where("text is not null")
    d = d.select(F.when(F.coalesce(F.col("source") == "leksikon", F.lit(False)), "general").otherwise("literary").alias("slice"), F.col("text").alias("body"), F.length("text").cast("long").alias("n_tokens"), F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("n_digit_tokens"))
    r = chunking.fertility(d, "slice", "body")
    return r.select("slice", *[F.col(c).cast("long").alias(c) for c in ("n_docs", "n_words", "n_bytes", "n_tokens", "n_digit_tokens", "soft_hyphens", "tabs")], *[F.round(c, 9).alias(c) for c in ("tokens_per_word", "bytes_per_token", "digit_token_share")], "fertility_p95")


@query()
def steps_per_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and steps of the stream that train_batches cuts, with each document's start token."""
    n = encoding.count_tokens(_training(spark, sf_dir), "rec_id", "text").agg(F.sum(F.col("n_tokens") + 1).alias("n_tokens"))
    return n.select("n_tokens", *[training.steps_per_epoch(F.col("n_tokens"), 2048, b).alias(f"steps_{b}") for b in (16, 32)])


@query()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(docs_of(spark, sf_dir, "rec_id", "source", "text"), "rec_id", "text", 512, keep=("source",))


@query("SELECT count(*) AS n_docs, 0::BIGINT AS n_faulty, true AS whole FROM corpus_docs WHERE text IS NOT NULL")
def chunk_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts have chunks, and how many of them are wrong: not given back whole, over budget, or with gaps."""
    d = docs_of(spark, sf_dir, "rec_id", "text").where("text is not null")
    c = cut(chunking.chunks(d, "rec_id", "text", 512), "chunks")
    bad = chunking.chunk_faults(d, c, "rec_id", "text", 512).agg(F.count(F.lit(1)).alias("n_faulty"))
    n = c.groupBy("rec_id").agg((F.count(F.lit(1)) == F.max("n_chunks")).alias("all")).agg(F.count(F.lit(1)).alias("n_docs"), F.min("all").alias("whole"))
    return n.join(F.broadcast(bad)).select("n_docs", "n_faulty", "whole")


@query()
def chunk_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 95th percentile and greatest length of chunks, and those at the budget and under 64 tokens, by source."""
    return chunking.length_report(cut(chunks(spark, sf_dir).select("source", "n_tokens"), "lengths"), "source", 512)


@query("""WITH m AS (SELECT source, length(text) AS n FROM corpus_docs WHERE text IS NOT NULL AND source IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY source) AS c FROM m)
SELECT source, count(*) AS n_chunks, sum(n)::BIGINT AS n_tokens, max(n) AS longest, count(*) FILTER (n = 512) AS at_budget, count(*) FILTER (n < 64) AS under_short, min(n) FILTER (k = floor(0.5 * (c - 1))::BIGINT) AS p50, min(n) FILTER (k = floor(0.95 * (c - 1))::BIGINT) AS p95 FROM r GROUP BY 1""")
def character_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of chunk_lengths over whole texts by their characters."""
    d = docs_of(spark, sf_dir, "source", "text").where("text is not null and source is not null").select("source", F.length("text").cast("long").alias("n_tokens"))
    return chunking.length_report(d, "source", 512)


@query()
def chunk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).where("chunk_index = 0")
    return c.groupBy("source").pivot("level", [-1, 0, 1, 2, 3]).agg(F.count(F.lit(1))).fillna(0)


@query()
def crop_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return chunking.crop_loss(c, ["rec_id", "chunk_index"], F.floor(F.col("rec_id") / 20_000).cast("long"), 512)


@query("SELECT v AS vocabulary, d AS width, n AS layers, 12 * d * d * n AS body, (2 + ceil(n / 2.0)::BIGINT) * v * d AS tables FROM (SELECT unnest([4096, 8192, 16384])::BIGINT AS v), (SELECT unnest([256, 384, 512])::BIGINT AS d), (SELECT unnest([6, 8])::BIGINT AS n)")
def vocab_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.parameters([4096, 8192, 16384], [(d, n) for d in (256, 384, 512) for n in (6, 8)])
    return spark.createDataFrame(rows, "vocabulary long, width long, layers long, body long, tables long")


@query()
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.vocabulary_table(spark)


@query()
def eval_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out pages tiled into windows of 256 tokens; every token but the first is a target once."""
    held = table(spark, sf_dir, "holdout_works").select("url").distinct()
    d = docs_of(spark, sf_dir, "rec_id", "url", "text").where("text is not null").join(held, "url", "left_semi").select("rec_id", "text")
    return chunking.tiles(encoding.with_ids(d, "text", first=50256), "rec_id", "tokens", 256)


ARCH = "[" + ", ".join(f"'{w}'" for w in ARCHAIC) + "]"
SHARE = "len(list_filter({w}, lambda x: list_contains(" + ARCH + ", x)))::DOUBLE / len({w})"


def _archaic(c: str):
    w = tx.words(F.lower(c))
    return F.size(F.filter(w, lambda x: x.isin(*ARCHAIC))) / F.nullif(F.size(w), F.lit(0))


SCORED = f"""s AS (SELECT pair_id, {SHARE.replace('{w}', words('lower(cankar)'))} AS a, {SHARE.replace('{w}', words('lower(plain)'))} AS b FROM train_pairs WHERE len({words("coalesce(lower(cankar), '')")}) > 0 AND len({words("coalesce(lower(plain), '')")}) > 0)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "train_pairs").select("pair_id", "cankar", "plain"))
    return t.select("pair_id", _archaic("cankar").alias("a"), _archaic("plain").alias("b")).where("a is not null and b is not null")


@query(f"WITH {SCORED} SELECT (SELECT count(*) FROM s) AS n_pos, (SELECT count(*) FROM s) AS n_neg, round(avg(CASE WHEN x.a > y.b THEN 1.0 WHEN x.a = y.b THEN 0.5 ELSE 0.0 END), 9) AS auc FROM s x, s y")
def style_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the share of archaic words tells sources from responses."""
    s = _scored(spark, sf_dir)
    both = s.select(F.col("a").alias("score"), F.lit(True).alias("source")).union(s.select("b", F.lit(False)))
    return evaluation.auc(both, "score", "source").withColumn("auc", F.round("auc", 9))


@query(f"WITH {SCORED} SELECT count(*) AS n, avg(CASE WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0.0 END) AS paired_auc, round(avg(a) - avg(b), 9) AS effect FROM s")
def style_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.paired_auc(_scored(spark, sf_dir), "a", "b").withColumn("effect", F.round("effect", 9))


CONTROLS = """p AS (SELECT pair_id, plain, cankar, row_number() OVER (ORDER BY pair_id) - 1 AS i, count(*) OVER () AS n FROM train_pairs WHERE plain IS NOT NULL AND cankar IS NOT NULL),
c AS (SELECT pair_id, plain AS source, cankar AS candidate, 'real' AS control FROM p UNION ALL SELECT pair_id, plain, plain, 'echo' FROM p UNION ALL SELECT x.pair_id, x.plain, y.cankar, 'mismatch' FROM p x JOIN p y ON y.i = (x.i + x.n // 2) % x.n)"""


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "train_pairs").select("pair_id", "plain", "cankar").where("plain is not null and cankar is not null"))
    return evaluation.mismatched(t, "pair_id", "plain", "cankar")


@query(f"WITH {CONTROLS} SELECT pair_id, control, sha256(source) AS source, sha256(candidate) AS candidate FROM c")
def judge_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _controls(spark, sf_dir).select("pair_id", "control", F.sha2("source", 256).alias("source"), F.sha2("candidate", 256).alias("candidate"))


VERDICTS = "v AS (SELECT pair_id, control, 1 + length(candidate) % 5 AS meaning, 1 + length(source) % 5 AS voice, 1 + (length(candidate) + length(source)) % 5 AS fluency FROM c)"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for a judge's answers: whole numbers from 1 to 5 out of lengths, by way of fenced JSON."""
    c, s = F.length("candidate"), F.length("source")
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct((1 + c % 5).alias("meaning"), (1 + s % 5).alias("voice"), (1 + (c + s) % 5).alias("fluency"), F.lit("-").alias("notes"))), F.lit("\n```"))
    d = _controls(spark, sf_dir).select(F.struct("pair_id", "control").alias("k"), raw.alias("raw"))
    return evaluation.verdicts_of(d, "k", "raw").select("k.*", "meaning", "voice", "fluency")


@query("""WITH s AS (SELECT rec.pair_id, length(cankar) % 97 / 97.0::DOUBLE AS o, length(cankar) % 89 / 101.0::DOUBLE AS p, length(plain) % 83 / 103.0::DOUBLE AS q FROM train_pairs rec WHERE cankar IS NOT NULL AND plain IS NOT NULL), m AS (SELECT count(*) AS n, avg(o) AS mo, avg(p) AS mp, avg(q) AS mq, avg(CASE WHEN o > q THEN 1.0 WHEN o = q THEN 0.5 ELSE 0.0 END) AS paired FROM s), u AS (SELECT avg(CASE WHEN x.o > y.q THEN 1.0 WHEN x.o = y.q THEN 0.5 ELSE 0.0 END) AS unpaired FROM s x, s y)
SELECT n, round(mo, 9) AS mean_own, round(mp, 9) AS mean_peer, round(mq, 9) AS mean_plain, round(paired, 9) AS paired_auc, round(unpaired, 9) AS unpaired_auc, round(mo - mq, 9) AS style_effect, round(mo - mp, 9) AS topic_effect, CASE WHEN unpaired >= 0.75 AND mo - mq > mo - mp THEN 'validated' ELSE 'measured_inadequate' END AS verdict FROM m, u""")
def style_deploy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style and topic effects, both AUCs and the verdict, of scores made up from lengths."""
    n = lambda c, m, d: (F.length(c) % m) / F.lit(float(d))
    t = spread(table(spark, sf_dir, "train_pairs").select("cankar", "plain")).select(n("cankar", 97, 97).alias("o"), n("cankar", 89, 101).alias("p"), n("plain", 83, 103).alias("q"))
    r = evaluation.deploy_check(t, "o", "p", "q")
    return r.select("n", *[F.round(c, 9).alias(c) for c in ("mean_own", "mean_peer", "mean_plain", "paired_auc", "unpaired_auc", "style_effect", "topic_effect")], "verdict")


@query("""WITH a AS (SELECT url AS artifact, content_sha256 AS sha256, row_number() OVER (ORDER BY url, content_sha256) AS i FROM (SELECT DISTINCT url, content_sha256 FROM holdout_works))
SELECT artifact, sha256, CASE WHEN i % 2 = 0 THEN 'validated' ELSE 'pending' END AS status FROM a""")
def deploy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded verdict of artifacts (held-out pages stand in for them); every second has a record of its own hash, the others one of another hash."""
    a = table(spark, sf_dir, "holdout_works").select(F.col("url").alias("artifact"), F.col("content_sha256").alias("sha256")).distinct()
    n = numbered(a, ["artifact", "sha256"])
    right = F.col("rn") % 2 == 0
    records = n.select(F.when(right, F.col("sha256")).otherwise(F.concat(F.lit("x"), "sha256")).alias("artifact_sha256"), F.lit("validated").alias("verdict"), F.lit("2026-01-01").alias("created_at"))
    return evaluation.deploy_status(a, records)


@query(f"WITH {CONTROLS}, v AS (SELECT pair_id, control, 1 + length(candidate) % 5 AS meaning FROM c), x AS (SELECT c.pair_id, c.control FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.pair_id = c.pair_id AND v.control = c.control AND v.meaning > 1)) SELECT control, count(*) AS n FROM x GROUP BY 1")
def unanswered_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls that no verdict came for, where those of the least meaning are lost."""
    k = F.struct("pair_id", "control").alias("k")
    items, answers = _controls(spark, sf_dir).select(k, "control"), _verdicts(spark, sf_dir).where("meaning > 1").select(k)
    return evaluation.without_verdict(items, answers, "k").groupBy("control").agg(F.count(F.lit(1)).alias("n"))


AVGS = ", ".join(f"round(avg({a}) FILTER (control = '{k}'), 9) AS {k}_{a}" for k in ("real", "echo", "mismatch") for a in ("meaning", "voice", "fluency"))


@query(f"""WITH {CONTROLS}, {VERDICTS}, m AS (SELECT {AVGS} FROM v), g AS (SELECT *, round(real_voice - echo_voice, 9) AS voice_margin, round(real_meaning - mismatch_meaning, 9) AS meaning_margin FROM m)
SELECT *, array_to_string(list_filter([CASE WHEN voice_margin < 1 THEN 'styling' END, CASE WHEN meaning_margin < 1 THEN 'content' END, CASE WHEN abs(mismatch_voice - real_voice) >= 1 THEN 'halo' END, CASE WHEN echo_meaning < real_meaning - 1 THEN 'echo_meaning' END], lambda x: x IS NOT NULL), '|') AS failures, false AS usable FROM g""")
def control_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by control, margins, and which of them fail."""
    m = evaluation.control_margins(_verdicts(spark, sf_dir))
    names = [f"{k}_{a}" for k in ("real", "echo", "mismatch") for a in ("meaning", "voice", "fluency")] + ["voice_margin", "meaning_margin"]
    return m.select(*[F.round(c, 9).alias(c) for c in names], F.array_join("failures", "|").alias("failures"), "usable")


@query(f"WITH {CONTROLS}, {VERDICTS} SELECT coalesce(control, 'all') AS series, count(*) AS n, round(avg(meaning), 9) AS meaning, round(avg(voice), 9) AS voice, round(avg(fluency), 9) AS fluency FROM v GROUP BY GROUPING SETS ((control), ())")
def series_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.series(_verdicts(spark, sf_dir), F.col("control"))
    return s.select("series", "n", *[F.round(a, 9).alias(a) for a in ("meaning", "voice", "fluency")])


BPB = f"""w AS (SELECT url IN (SELECT url FROM holdout_works) AS held, unnest(regexp_extract_all({fold('text')}, '{tx.WORD}+')) AS w FROM corpus_docs WHERE text IS NOT NULL AND url IS NOT NULL),
n AS (SELECT w, count(*) AS n FROM w WHERE NOT held GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS k FROM n), x AS (SELECT w.w, -ln((coalesce(n.n, 0) + 1)::DOUBLE / (t.t + t.k + 1)) AS nats FROM w LEFT JOIN n ON n.w = w.w, t WHERE held)"""


@query(f"WITH {BPB} SELECT round(sum(nats) / (ln(2) * sum(strlen(w))), 9) AS bpb, sum(strlen(w))::BIGINT AS n_bytes FROM x")
def unigram_bpb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per byte of the held-out pages' words under a unigram model of all others."""
    held = table(spark, sf_dir, "holdout_works").select("url").distinct().withColumn("held", F.lit(True))
    d = docs_of(spark, sf_dir, "url", "text").where("text is not null and url is not null").join(held, "url", "left")
    w = d.select(F.coalesce("held", F.lit(False)).alias("held"), F.explode(tx.tokens("text")).alias("w"))
    s = evaluation.unigram_nats(w.where("not held"), w.where("held"), "w").withColumn("b", F.octet_length("w"))
    return evaluation.bits_per_byte(s, "nats", "b").select(F.round("bpb", 9).alias("bpb"), F.col("n_bytes").cast("long").alias("n_bytes"))


def _style_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, author, text, label) of prose by known authors without what is held out; label: by the roster's first author."""
    works = table(spark, sf_dir, "holdout_works")
    d = docs_of(spark, sf_dir, "rec_id", "url", "text", "source", "author").where("source = 'wikivir' and author is not null and text is not null")
    same = cut(holdout.contained(d.withColumnRenamed("rec_id", "key"), works).withColumnRenamed("key", "rec_id"), "contained")
    first = F.col("author") == F.lit((table(spark, sf_dir, "authors").where("author_id = 1").select("name").first() or [""])[0])
    kept = holdout.without(d, "url", works).join(same, "rec_id", "left_anti").where(~F.coalesce(gate.is_verse(F.col("text")), F.lit(False)))
    return kept.select("rec_id", "author", "text", first.alias("label"))


def _style(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cut(_style_docs(spark, sf_dir), "prose")
    return evaluation.style_passages(d.select("rec_id", "text"), "rec_id", "text").join(d.select("rec_id", "label"), "rec_id")


def _style_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, cluster) of records of one author half contained in one another."""
    s = dedup.shingle_sets(_style_docs(spark, sf_dir), "rec_id", "text", keep=("author",))
    return dedup.cluster(dedup.containment_pairs(s, "rec_id", 0.5, part=["author"]), s, "rec_id")


@query()
def style_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _style(spark, sf_dir)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, passage, label, author, cluster) of prose by known authors, clusters of near duplicates told."""
    d = cut(_style_docs(spark, sf_dir), "prose")
    p = evaluation.style_passages(d.select("rec_id", "text"), "rec_id", "text").join(d.select("rec_id", "label", "author"), "rec_id")
    return cut(p.join(_style_clusters(spark, sf_dir), "rec_id"), "style")


@query()
def style_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated AUC and average precision by fold of telling the roster's first author, by each family of features; clusters of near duplicates are kept whole."""
    p = _labelled(spark, sf_dir)
    one = lambda f: cut(evaluation.fold_metrics(evaluation.cross_validate(p, "passage", "label", "cluster", f)), "metrics").withColumn("family", F.lit(f))
    return reduce(DataFrame.union, map(one, evaluation.FAMILIES))


@query()
def style_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over the folds by family."""
    m = cut(style_folds(spark, sf_dir), "metrics")
    return m.groupBy("family").agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"), F.avg("average_precision").alias("average_precision_mean"))


@query()
def style_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean out-of-fold probability of the first author's style by author."""
    return evaluation.author_means(evaluation.cross_validate(_labelled(spark, sf_dir), "passage", "label", "cluster", keep=("author",)), "author")


@query()
def style_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that speak most for and against the first author."""
    p = _labelled(spark, sf_dir).withColumn("fold", F.lit(0))
    return evaluation.top_features(evaluation.style_models(p, "passage", "label", "fold", "characters", k=1))


@query("WITH x AS (SELECT DISTINCT pair_id, length(cankar) % 211 AS s, length(plain) % 3 = 0 AS y FROM train_pairs WHERE cankar IS NOT NULL AND plain IS NOT NULL), g AS (SELECT s, count(*) FILTER (y) AS p, count(*) AS n FROM x GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS sp, sum(n) OVER (ORDER BY s DESC) AS sn FROM g) SELECT round(sum(p * (sp / sn::DOUBLE)) / sum(p), 9) AS average_precision FROM c")
def style_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of scores made up from lengths."""
    t = spread(table(spark, sf_dir, "train_pairs").select("pair_id", "cankar", "plain").where("cankar is not null and plain is not null"))
    s = t.select((F.length("cankar") % 211).alias("s"), (F.length("plain") % 3 == 0).alias("y"))
    return evaluation.average_precision(s, "s", "y").withColumn("average_precision", F.round("average_precision", 9))


@query()
def train_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 8 rows of 256 targets over the tokens of all records but what is held out, each document after a start token."""
    t = cut(encoding.with_ids(_training(spark, sf_dir), "text", first=50256).select("rec_id", "tokens"), "ids")
    at = cut(training.placed(t.select("rec_id", F.size("tokens").alias("n")), "rec_id", "n").select("rec_id", "pos", "n"), "placed")  # positions alone are ordered; tokens stay where they are written
    total = at.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return training.batch_rows(t.join(at.select("rec_id", "pos"), "rec_id").select("pos", "tokens"), "tokens", 256, 8, total)



SPECIAL = {"bos": 50256, "user_start": 50257, "user_end": 50258, "assistant_start": 50259, "assistant_end": 50260}


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "train_pairs").select("pair_id", "cankar", "plain").where("cankar is not null and plain is not null"))
    a = encoding.with_ids(t, "plain").withColumnRenamed("tokens", "prompt")
    return training.chat_examples(encoding.with_ids(a.select("pair_id", "cankar", "prompt"), "cankar"), "pair_id", "prompt", "tokens", SPECIAL, 512)


@query()
def chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select("pair_id", F.size("tokens").alias("n_tokens"), "n_prompt", "n_target", "fits")


@query()
def collated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(_examples(spark, sf_dir).where("fits"), "examples")
    b = training.length_batches(e.withColumn("n", F.size("tokens")), "pair_id", "n", 16)
    return training.collate(e.join(b, "pair_id"), "batch").select("batch", "pair_id", "x", "y")


@query("""SELECT rec_id, ((row_number() OVER (ORDER BY length(text), ('0x' || md5(rec_id::VARCHAR)[1:15])::BIGINT, rec_id) - 1) // 16)::BIGINT AS batch FROM corpus_docs WHERE text IS NOT NULL""")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in groups of 16 by length; equal lengths by a hash that SQL has too."""
    d = docs_of(spark, sf_dir, "rec_id", "text").where("text is not null").select("rec_id", F.length("text").alias("n"))
    h = F.conv(F.substring(F.md5(F.col("rec_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return training.length_batches(d, "rec_id", "n", 16, order=h)


@query("SELECT sum(out_tokens)::BIGINT AS n_target, greatest(1, round_even(sum(out_tokens) * (0.2::DOUBLE / 0.8) / 512, 0))::BIGINT AS windows FROM train_pairs")
def replay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "train_pairs").agg(F.sum("out_tokens").cast("long").alias("n_target"))
    return n.select("n_target", training.replay_windows(F.col("n_target"), 512, 0.2).cast("long").alias("windows"))


@query("SELECT s AS step, CASE WHEN s < 10 THEN 0.3 * (s + 1) / 10 ELSE 0.3 * (0.1 + 0.9 * 0.5 * (1 + cos(least(greatest((s - 10)::DOUBLE / 90, 0.0), 1.0) * pi()))) END AS lr FROM (SELECT unnest(range(0, 110)) AS s)")
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(110).select(F.col("id").alias("step"), training.learning_rate(F.col("id"), 10, 100, 0.3).alias("lr"))


@query(RECEIPTS)
def receipts_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of receipts by a stream that takes what is there; its first-seen times come from the log."""
    src = f"{sf_dir}/batch_receipts.parquet"
    log = spark.read.parquet(src)
    base = f"{shared_dir(spark)}/zrno-stream-{uuid.uuid4().hex[:12]}"
    log.write.parquet(f"{base}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{base}/log")
    incremental.fold(stream, "batch_id", ["logged_at", "downloaded", "n_requests", "model"], ["created_at", "pair_set"], f"{base}/state", f"{base}/check").awaitTermination()
    first = log.groupBy("batch_id").agg(F.min("logged_at").alias("first_seen"))
    return incremental.newest(spark, f"{base}/state").join(first, "batch_id").select("batch_id", "created_at", "downloaded", "n_requests", "first_seen")


