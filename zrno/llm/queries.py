"""The queries of this folder, and the SQL to check them against where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zrno.llm import defects, levels, mixing, mojibake, near, packing, scans, spans, splits, tokens
from zrno.session import cut, spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def kept(sql: str):
    """Registers a query of what must hold of another's result, with the SQL that states it."""

    def wrap(f):
        ORACLES[f.__name__] = sql
        return query(f)

    return wrap


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "train_pairs").select("pair_id", "cankar", "plain"))
    r = defects.flag_pairs(d, "pair_id", "cankar", "plain")
    return r.select("pair_id", defects.first_defect(F.col("defects")).alias("defect")).where("defect is not null")


@query
def p1_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triggered defect of each pair, with the logged token count beside the size of the text."""
    t = spread(table(spark, sf_dir, "train_pairs").select("pair_id", "cankar", "plain", "out_tokens"))
    r = defects.flag_pairs(t, "pair_id", "cankar", "plain", "out_tokens")
    return r.join(t.select("pair_id", "out_tokens", F.length("plain").alias("n_chars")), "pair_id").select("pair_id", F.explode_outer("defects").alias("defect"), "out_tokens", "n_chars")


def _tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "corpus_docs").select("rec_id", "source", "author", "url"))
    return splits.entities(docs, table(spark, sf_dir, "authors").select("author_id", "name", "aliases"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tied(spark, sf_dir).where("group_id is not null").select("rec_id", F.col("group_id").cast("bigint"))


@query
def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's split, 80/10/10."""
    return splits.assign_splits(_tied(spark, sf_dir), {"train": 0.8, "validation": 0.1, "test": 0.1})


@kept("SELECT count(*) AS n_records, 0::BIGINT AS n_torn, true AS near_quota FROM corpus_docs")
def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record has a split, no component is torn, and every split is within a hundredth of its quota."""
    s = cut(p2_splits(spark, sf_dir), "splits")
    torn = s.groupBy("component").agg(F.countDistinct("split").alias("k")).agg(F.coalesce(F.sum((F.col("k") > 1).cast("long")), F.lit(0)).alias("n_torn"))
    n = s.agg(F.count(F.lit(1)).alias("n_records"), *[F.avg((F.col("split") == k).cast("int")).alias(k) for k in ("train", "validation", "test")])
    near_quota = F.greatest(*[F.abs(F.col(k) - q) for k, q in (("train", 0.8), ("validation", 0.1), ("test", 0.1))]) <= 0.01
    return n.join(F.broadcast(torn)).select("n_records", "n_torn", near_quota.alias("near_quota"))


@kept("""WITH t AS (SELECT rec_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM corpus_docs WHERE text IS NOT NULL), s AS (SELECT rec_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM t WHERE len(w) >= 5),
n AS (SELECT rec_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.rec_id AS a, y.rec_id AS b, count(*) AS c FROM s x JOIN s y USING (s) WHERE x.rec_id < y.rec_id GROUP BY 1, 2)
SELECT a AS rec_id_a, b AS rec_id_b FROM p JOIN n na ON na.rec_id = a JOIN n nb ON nb.rec_id = b WHERE c >= 0.5 * (na.n + nb.n - c)""")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "corpus_docs").select("rec_id", "text"))
    classes, pairs = near.near_pairs(docs, "rec_id", "text", least=0.5, weighted=False)
    return near.expand(classes, pairs).select(F.col("a").alias("rec_id_a"), F.col("b").alias("rec_id_b"))


@query
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts whose bags of shingles are similar to 0.8 or more."""
    docs = spread(table(spark, sf_dir, "corpus_docs").select("rec_id", "text"))
    return near.groups(*near.near_pairs(docs, "rec_id", "text")).withColumnRenamed("id", "rec_id")


@query
def p6_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pairs, found, recall): of all pairs of texts whose bags are similar to 0.8 or more, by an exact join on their rarest shingles, those that signatures lead to."""
    docs = spread(table(spark, sf_dir, "corpus_docs").select("rec_id", "text"))
    classes, pairs = near.near_pairs(docs, "rec_id", "text")
    every = near.exact_pairs(docs.join(classes.where("id = class_id").select(F.col("id").alias("rec_id")), "rec_id", "left_semi"), "rec_id", "text")
    j = every.join(pairs.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("found"))
    return j.withColumn("recall", F.when(F.col("pairs") == 0, F.lit(1.0)).otherwise(F.col("found") / F.col("pairs")))


@kept("""WITH w AS (SELECT DISTINCT rec_id, substring(text, i, 150) AS w FROM (SELECT rec_id, text, unnest(range(1, length(text) - 148)) AS i FROM corpus_docs WHERE length(text) >= 150))
SELECT DISTINCT x.rec_id AS rec_id_a, y.rec_id AS rec_id_b FROM w x JOIN w y USING (w) WHERE x.rec_id < y.rec_id""")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "corpus_docs").select("rec_id", "text"))
    classes, pairs = spans.shared_pairs(docs, "rec_id", "text", span=150)
    return near.expand(classes, pairs).select(F.col("a").alias("rec_id_a"), F.col("b").alias("rec_id_b"))


@query
def p4_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record stands elsewhere, nothing for null and short texts, beside what was recorded for held-out works of the same page; of several records of a page the greatest."""
    docs = spread(table(spark, sf_dir, "corpus_docs").select("rec_id", "text", "url"))
    s = spans.shared_share(docs.select("rec_id", "text"), "rec_id", "text", span=150).select(F.col("id").alias("rec_id"), "shared_chars", "share")
    works = table(spark, sf_dir, "holdout_works").select(splits.page_key("url").alias("page"), "max_containment_elsewhere").where("page is not null")
    told = works.groupBy("page").agg(F.max("max_containment_elsewhere").alias("recorded"))
    d = docs.select("rec_id", F.length("text").cast("long").alias("n_chars"), splits.page_key("url").alias("page")).join(told, "page", "left").drop("page")
    return d.join(s, "rec_id", "left").select("rec_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("share", F.lit(0.0)).alias("share"), "recorded")


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "corpus_docs").select("rec_id", "text"))
    return mojibake.restore(docs, "rec_id", "text").select("rec_id")


@query
def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected records with their source, what happened to them, and their restored text."""
    docs = spread(table(spark, sf_dir, "corpus_docs").select("rec_id", "text", "source"))
    return mojibake.restore(docs, "rec_id", "text").join(docs.select("rec_id", "source"), "rec_id")


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "corpus_docs").select("rec_id", "text", "title", "author"))
    return scans.noise(docs, "rec_id", "text", "title", "author")


@query
def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of noisy records and of all records a metadata record's text stream leads to."""
    docs = spread(table(spark, sf_dir, "corpus_docs").select("rec_id", "text", "title", "author", "url"))
    urn = F.upper(F.regexp_extract("text_url", r"(?i)(urn:[a-z0-9:]+-[a-z0-9]+)", 1))
    streams = table(spark, sf_dir, "edm_records").where("text_url is not null").select(urn.alias("urn")).distinct()
    tied = docs.select("rec_id", F.upper(F.regexp_extract("url", r"(?i)(urn:[a-z0-9:]+-[a-z0-9]+)", 1)).alias("urn")).where("urn <> ''").join(streams, "urn").select("rec_id")
    return scans.repair(docs, "rec_id", "text", "title", "author", tied)


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    labels = table(spark, sf_dir, "level_labels").select("doc_id", "level", "rater")
    return levels.grade(docs, labels, "doc_id", "text", "source", least=200)


@query
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 2,048 tokens that each document lies in."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(docs, "doc_id", "text", capacity=2048)


@kept("SELECT count(*) AS n_documents, 0::BIGINT AS n_over, 0::BIGINT AS n_split, true AS tight FROM documents")
def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document lies somewhere, no container is over its capacity, no document that fits is split, and containers are at most a hundredth more than their tokens need."""
    c = cut(p7_containers(spark, sf_dir), "containers")
    fill = c.groupBy("container").agg(F.sum("n_tokens").alias("fill")).agg(F.sum((F.col("fill") > 2048).cast("long")).alias("n_over"), F.count(F.lit(1)).alias("k"), F.sum("fill").alias("all"))
    docs = c.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(((F.col("n") <= 2048) & (F.col("rows") > 1)).cast("long")).alias("n_split"))
    return docs.join(F.broadcast(fill)).select("n_documents", "n_over", "n_split", (F.col("k") <= 1.01 * F.ceil(F.col("all") / 2048) + 1).alias("tight"))


@query
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document stands in the mix, with its source's share as asked for and as reached."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    targets = table(spark, sf_dir, "mix_targets")
    m = cut(mixing.mix(docs, targets, "doc_id", "text", "source"), "mix")
    return m.join(mixing.shares(m, targets).select("source", "target_share", "actual_share"), "source")


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(cut(mixing.mix(docs, targets, "doc_id", "text", "source"), "mix"), targets)


@kept("SELECT source, target_share, true AS within_repeats, true AS as_near FROM mix_targets")
def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No document stands more often than its source allows, and every source either has its target's share of what all uncapped ones reach, to a twentieth, or is used up."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    targets = table(spark, sf_dir, "mix_targets")
    m = cut(mixing.mix(docs, targets, "doc_id", "text", "source"), "mix")
    s = mixing.shares(m, targets).join(targets.select("source", "max_repeats"), "source")
    sizes = tokens.count_tokens(docs, "doc_id", "text", keep=("source",)).groupBy("source").agg(F.sum("n_tokens").alias("have"))
    s = cut(s.join(sizes, "source", "left").withColumn("up", F.col("actual_share") / F.col("target_share")), "shares")
    top = s.agg(F.max("up").alias("top"))
    used = F.coalesce(F.col("n_tokens") >= 0.95 * F.col("have") * F.col("max_repeats"), F.lit(True))
    return s.join(F.broadcast(top)).select("source", "target_share", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), ((F.col("up") >= 0.95 * F.col("top")) | used).alias("as_near"))
