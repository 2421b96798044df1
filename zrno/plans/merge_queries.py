"""Queries over near duplicates and the merge, with the SQL that takes the same decisions one record at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zrno.operators import dedup
from zrno.operators.ledger import collisions as shared_titles
from zrno.plans import merge
from zrno.plans.corpus_queries import SHINGLES, SIGNALS, VERDICT, docs_of, sets_of
from zrno.plans.ledger_queries import KEY
from zrno.plans.registry import query
from zrno.plans.text_queries import normal
from zrno.session import cut, table


def greedy(nodes: str, edges: str) -> str:
    """SQL of a first-come selection over `nodes` (node) in their order with `edges` (early, late): r (node, kept, root)."""
    return f"""gn AS (SELECT node, row_number() OVER (ORDER BY node) AS rn FROM (SELECT early AS node FROM {edges} UNION SELECT late FROM {edges})),
gs(i, kept) AS (SELECT 0::BIGINT, [(SELECT min(node) FROM gn)][1:0] UNION ALL SELECT gs.i + 1, CASE WHEN EXISTS (SELECT 1 FROM {edges} e WHERE e.late = gn.node AND list_contains(gs.kept, e.early)) THEN gs.kept ELSE list_append(gs.kept, gn.node) END FROM gs JOIN gn ON gn.rn = gs.i + 1),
gk AS (SELECT unnest(kept) AS node FROM (SELECT kept FROM gs ORDER BY i DESC LIMIT 1)),
r AS (SELECT n.node, n.node NOT IN (SELECT node FROM gn) OR n.node IN (SELECT node FROM gk) AS kept, CASE WHEN n.node IN (SELECT node FROM gn) AND n.node NOT IN (SELECT node FROM gk) THEN (SELECT min(e.early) FROM {edges} e WHERE e.late = n.node AND e.early IN (SELECT node FROM gk)) ELSE n.node END AS root FROM {nodes} n)"""


NEAR = """np AS (SELECT x.rec_id AS early, y.rec_id AS late, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.rec_id < y.rec_id GROUP BY 1, 2),
ne AS (SELECT early, late FROM np JOIN n na ON na.rec_id = early JOIN n nb ON nb.rec_id = late WHERE c::DOUBLE / (na.n + nb.n - c) >= 0.8), nn AS (SELECT rec_id AS node FROM tok)"""


@query(f"WITH RECURSIVE {SHINGLES}, {NEAR}, {greedy('nn', 'ne')} SELECT node AS rec_id, kept, root AS root_id FROM r")
def near_dups_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-come selection over near duplicates in the order of records."""
    s = sets_of(spark, sf_dir)
    e = dedup.jaccard_pairs(s.select("rec_id", "sh", "n"), "rec_id", 0.8).select(F.col("a").alias("early"), F.col("b").alias("late"))
    return dedup.greedy_keep(s.select(F.col("rec_id").alias("node")), e).select(F.col("node").alias("rec_id"), "kept", F.col("root").alias("root_id"))


@query(f"""WITH RECURSIVE {SHINGLES}, p0 AS (SELECT source = 'leksikon' AS general, * FROM tok), np AS (SELECT x.rec_id AS early, y.rec_id AS late, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.rec_id < y.rec_id AND (x.source = 'leksikon') IS NOT DISTINCT FROM (y.source = 'leksikon') GROUP BY 1, 2),
ne AS (SELECT early, late FROM np JOIN n na ON na.rec_id = early JOIN n nb ON nb.rec_id = late WHERE c::DOUBLE / (na.n + nb.n - c) >= 0.8), nn AS (SELECT rec_id AS node FROM tok), {greedy('nn', 'ne')}
SELECT CASE WHEN coalesce(source = 'leksikon', false) THEN 'general' ELSE 'literary' END AS part, count(*) AS n_docs, count(*) FILTER (NOT kept) AS n_duplicates, count(DISTINCT root) FILTER (NOT kept) AS n_clusters, round(count(*) FILTER (NOT kept)::DOUBLE / count(*), 5) AS duplicate_rate FROM r JOIN tok ON tok.rec_id = r.node GROUP BY 1""")
def near_dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records repeat an earlier one of the general or of the literary part, and how many earlier ones have repetitions."""
    s = sets_of(spark, sf_dir).withColumn("part", F.when(F.coalesce(F.col("source") == "leksikon", F.lit(False)), "general").otherwise("literary"))
    kept = None
    for part in ("general", "literary"):
        x = s.where(F.col("part") == part)
        e = dedup.jaccard_pairs(x.select("rec_id", "sh", "n"), "rec_id", 0.8).select(F.col("a").alias("early"), F.col("b").alias("late"))
        one = dedup.greedy_keep(x.select(F.col("rec_id").alias("node")), e).withColumn("part", F.lit(part))
        kept = one if kept is None else kept.union(one)
    dup = ~F.col("kept")
    g = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(dup.cast("long")).alias("n_duplicates"), F.countDistinct(F.when(dup, F.col("root"))).alias("n_clusters"))
    return g.withColumn("duplicate_rate", F.round(F.col("n_duplicates") / F.col("n_docs"), 5))


@query(f"WITH {SHINGLES}, {NEAR} SELECT early AS a, late AS b FROM ne")
def near_dups_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that banded MinHash signatures lead to, compared exactly."""
    return dedup.lsh_pairs(sets_of(spark, sf_dir).select("rec_id", "sh", "n"), "rec_id", 0.8)


@query(f"WITH {SHINGLES}, {NEAR} SELECT rec_id, coalesce((SELECT min(early) FROM ne WHERE late = rec_id), -1) AS root_id FROM tok")
def near_dups_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest record that each repeats, by an index of all records; -1 for none."""
    s = sets_of(spark, sf_dir).select("rec_id", "sh", "n")
    return dedup.lsh_match(dedup.lsh_index(s, "rec_id"), s, "rec_id", 0.8, earlier=True).withColumn("root_id", F.coalesce("root_id", F.lit(-1)))


FLAGGED = "fl AS (SELECT DISTINCT author, title FROM corpus_docs WHERE title IS NOT NULL AND author IN (SELECT name FROM authors WHERE author_id % 40 = 7))"
TITLE = normal("nfc_normalize(coalesce(title, ''))")
COLLISIONS = f"""co AS (SELECT t AS title, CASE WHEN count(*) = 2 THEN 'distinct' ELSE 'same_work' END AS resolution, CASE WHEN count(*) > 2 THEN min(author) END AS attribution FROM (SELECT DISTINCT author, {normal('nfc_normalize(title)')} AS t FROM corpus_docs WHERE author IS NOT NULL AND title IS NOT NULL) WHERE t <> '' GROUP BY 1 HAVING count(*) > 1)"""
MERGE = f"""{SIGNALS}, {SHINGLES}, {FLAGGED}, {COLLISIONS}, fw AS (SELECT DISTINCT author, {KEY} AS work FROM fl),
p AS (SELECT d.rec_id, d.title, d.author, coalesce(d.text, '') AS body, {KEY} AS work, {TITLE} AS tk, CASE WHEN d.shard = 'leksikon' THEN 3 WHEN d.shard LIKE 'dlib-%' AND d.shard LIKE '%-gapfill' THEN 2 WHEN d.shard LIKE 'dlib-%' THEN 1 ELSE 0 END AS tier, coalesce(d.shard, '') AS sd, {VERDICT} AS verdict FROM corpus_docs d JOIN v ON v.rec_id = d.rec_id),
q AS (SELECT *, tier < 3 AS literary, tier::VARCHAR || '|' || sd || '|' || lpad(rec_id::VARCHAR, 19, '0') AS pref, coalesce(work <> '' AND (author, work) IN (SELECT author, work FROM fw), false) AS wrong FROM p),
lv AS (SELECT *, first_value(rec_id) OVER (PARTITION BY body ORDER BY pref) AS rep FROM q WHERE NOT wrong AND NOT (literary AND verdict <> 'kept')),
rp AS (SELECT * FROM lv WHERE rep = rec_id),
mp AS (SELECT x.rec_id AS a, y.rec_id AS b, count(*) AS c FROM sh x JOIN rp ON rp.rec_id = x.rec_id JOIN sh y USING (s) JOIN rp ry ON ry.rec_id = y.rec_id WHERE x.rec_id <> y.rec_id GROUP BY 1, 2),
mn AS (SELECT mp.*, na.n AS na, nb.n AS nb, ra.pref AS pa, rb.pref AS pb, ra.author AS xa, rb.author AS xb, ra.tk AS ta, rb.tk AS tb, ra.work AS wa, rb.work AS wb, ra.literary AS la, rb.literary AS lb, ra.title AS oa, rb.title AS ob FROM mp JOIN n na ON na.rec_id = a JOIN n nb ON nb.rec_id = b JOIN rp ra ON ra.rec_id = a JOIN rp rb ON rb.rec_id = b),
ties AS (SELECT least(pa, pb) AS early, greatest(pa, pb) AS late, 'near_dup' AS why FROM mn WHERE a < b AND c::DOUBLE / (na + nb - c) >= 0.8 AND NOT (xa IS DISTINCT FROM xb AND (ta IN (SELECT title FROM co WHERE resolution = 'distinct') OR tb IN (SELECT title FROM co WHERE resolution = 'distinct')))
  UNION SELECT least(pa, pb), greatest(pa, pb), 'registry_identity' FROM mn WHERE la AND lb AND xa = xb AND wa = wb AND wa <> '' AND c::DOUBLE / na >= 0.5),
te AS (SELECT DISTINCT early, late FROM ties), tn AS (SELECT pref AS node FROM rp), {greedy('tn', 'te')},
wy AS (SELECT late, max(why) AS why, min(early) AS root FROM ties WHERE early IN (SELECT node FROM r WHERE kept) GROUP BY 1),
f0 AS (SELECT rp.rec_id, CASE WHEN r.kept THEN 'kept' ELSE wy.why END AS fate, CASE WHEN NOT r.kept THEN ro.rec_id END AS root_id FROM rp JOIN r ON r.node = rp.pref LEFT JOIN wy ON wy.late = rp.pref LEFT JOIN rp ro ON ro.pref = wy.root),
cn AS (SELECT mn.a, first(mn.b ORDER BY c::DOUBLE / na DESC, b) AS container FROM mn JOIN f0 fa ON fa.rec_id = a AND fa.fate = 'kept' JOIN f0 fb ON fb.rec_id = b AND fb.fate = 'kept' WHERE la AND lb AND xa = xb AND oa IS DISTINCT FROM ob AND na < 3000 AND nb >= 3000 AND c::DOUBLE / na > 0.95 GROUP BY 1),
ft AS (SELECT f0.rec_id, CASE WHEN cn.a IS NOT NULL THEN 'containment' ELSE fate END AS fate, coalesce(cn.container, root_id) AS root_id FROM f0 LEFT JOIN cn ON cn.a = f0.rec_id),
dc AS (SELECT lv.rec_id, CASE WHEN lv.rec_id = lv.rep THEN fate WHEN fate IN ('kept', 'containment') THEN 'exact_dup' ELSE fate END AS decision, CASE WHEN lv.rec_id <> lv.rep AND fate IN ('kept', 'containment') THEN lv.rep ELSE root_id END AS root_id FROM lv JOIN ft ON ft.rec_id = lv.rep
  UNION ALL SELECT rec_id, CASE WHEN wrong THEN 'not_by_author' ELSE 'gate_' || verdict END, NULL FROM q WHERE wrong OR (literary AND verdict <> 'kept')),
cr AS (SELECT dc.rec_id, dc.root_id, dc.decision, x.author, y.author AS root_author, x.title, {TITLE.replace('title', 'x.title')} AS tk FROM dc JOIN corpus_docs x ON x.rec_id = dc.rec_id JOIN corpus_docs y ON y.rec_id = dc.root_id WHERE x.author IS DISTINCT FROM y.author)"""
DOCS = ("rec_id", "shard", "title", "url", "text", "source", "author")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, flagged works, collisions): works of every fortieth author of the roster stand in for flagged ones; titles of two authors for distinct works, those of more for one work of the first author."""
    docs = docs_of(spark, sf_dir, *DOCS)
    names = table(spark, sf_dir, "authors").where("author_id % 40 = 7").select(F.col("name").alias("author"))
    flagged = docs.where("title is not null").select("author", "title").join(names, "author", "left_semi").distinct()
    c = shared_titles(docs.select("author", "title").where("title is not null"))
    two = F.col("n_authors") == 2
    return docs, flagged, cut(c.select(F.col("title_key").alias("title"), F.when(two, "distinct").otherwise("same_work").alias("resolution"), F.when(~two, F.array_min("authors")).alias("attribution")), "collisions")


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, flagged, collisions = _tables(spark, sf_dir)
    return docs, cut(merge.decisions(docs, collisions=collisions, flagged=flagged), "decisions"), collisions


@query(f"WITH RECURSIVE {MERGE} SELECT rec_id, decision, coalesce(root_id, -1) AS root_id FROM dc")
def merge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision for every record, and the kept record it repeats, -1 for none."""
    docs, flagged, collisions = _tables(spark, sf_dir)
    return merge.decisions(docs, collisions=collisions, flagged=flagged).withColumn("root_id", F.coalesce("root_id", F.lit(-1)))


@query(f"WITH RECURSIVE {MERGE} SELECT decision, count(*) AS n_docs FROM dc GROUP BY 1")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_decisions(spark, sf_dir).groupBy("decision").agg(F.count(F.lit(1)).alias("n_docs"))


@query(f"""WITH RECURSIVE {MERGE}, gv AS (SELECT root_id, last(attribution ORDER BY cr.rec_id) AS given FROM cr JOIN co ON co.title = cr.tk AND attribution IS NOT NULL WHERE cr.title IS NOT NULL GROUP BY 1)
SELECT d.rec_id, d.title, d.url, sha256(d.text) AS text, length(d.text) AS n_chars, d.source, coalesce(given, d.author) AS author FROM corpus_docs d JOIN dc ON dc.rec_id = d.rec_id AND decision = 'kept' LEFT JOIN gv ON gv.root_id = d.rec_id""")
def merged_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged corpus; texts by their hash, so that the SQL's result stays small."""
    docs, decided, collisions = _decided(spark, sf_dir)
    return merge.survivors(docs, decided, collisions).withColumn("text", F.sha2("text", 256))


@query(f"WITH RECURSIVE {MERGE} SELECT rec_id, root_id, decision, author, root_author, title FROM cr")
def merge_cross_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, decided, _ = _decided(spark, sf_dir)
    return merge.cross_author(docs, decided)


@query(f"WITH {FLAGGED}, {COLLISIONS} SELECT resolution, count(*) AS n_titles, count(attribution) AS n_given FROM co GROUP BY 1")
def collision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)[2].groupBy("resolution").agg(F.count(F.lit(1)).alias("n_titles"), F.count("attribution").alias("n_given"))
