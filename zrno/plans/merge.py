"""Merging shards into one corpus: gate, exact, identity, near and contained duplicates, with a decision for every record.

Order of preference is (tier, shard, record). Cheap signals come first, each on what the ones before left. A text that stands
more than once is represented by its most preferred copy; copies share its fate, `exact_dup` where it is kept. Later records
tied to a kept earlier one, by the same work and half its runs or by near equality, are dropped. What is left is dropped if it
stands almost whole in a larger work of the same author.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zrno.functions.text import nfc, normal_title, without_author
from zrno.operators import dedup, gate
from zrno.session import cut


@dataclass(frozen=True)
class MergeParams:
    general: str = "leksikon"  # the shard without an author, which isn't gated
    near: float = 0.8
    identity: float = 0.5
    contained: float = 0.95
    partly: float = 0.80
    container: int = 3000  # runs that a work must have to contain others


def shard_tier(shard: Column, general: str) -> Column:
    return F.when(shard == general, 3).when(shard.startswith("dlib-") & shard.endswith("-gapfill"), 2).when(shard.startswith("dlib-"), 1).otherwise(0)


def containment_verdict(score: Column, p: MergeParams = MergeParams()) -> Column:
    return F.when(score > p.contained, "drop").when(score > p.partly, "partial").otherwise("none")


def prepared(docs: DataFrame, p: MergeParams) -> DataFrame:
    """Adds pref, a number whose order is that of preference, and literary."""
    d = docs.select("rec_id", "shard", "title", "url", "text", "source", "author").withColumn("tier", shard_tier(F.coalesce("shard", F.lit("")), p.general))
    return d.withColumns({"literary": F.col("tier") < 3, "pref": F.format_string("%d|%s|%019d", "tier", F.coalesce("shard", F.lit("")), "rec_id")})


def _work(author: Column, title: Column) -> Column:
    return normal_title(without_author(nfc(F.coalesce(title, F.lit(""))), author))


def decisions(docs: DataFrame, p: MergeParams = MergeParams(), collisions: DataFrame | None = None, flagged: DataFrame | None = None) -> DataFrame:
    """(rec_id, decision, root_id) of every record; root_id is the kept record that a dropped one repeats.

    collisions: (title, resolution, attribution) by normal title; `distinct` works of other authors are never near duplicates.
    flagged: (author, title) of works filed under an author who did not write them; they are left out before all else.
    """
    d = prepared(docs, p)
    wrong = None
    if flagged is not None:
        keys = flagged.select("author", _work(F.col("author"), F.col("title")).alias("work")).where("work <> ''").distinct()
        wrong = cut(d.select("rec_id", "author", _work(F.col("author"), F.col("title")).alias("work")).join(keys, ["author", "work"], "left_semi").select("rec_id"), "flagged")
        d = d.join(wrong, "rec_id", "left_anti")
    d = gate.signals(d).withColumn("gated", F.col("literary") & (F.col("verdict") != "kept"))
    hashed = dedup.content_hash(F.coalesce("text", F.lit("")))
    d = d.select("rec_id", "pref", "literary", "gated", "verdict", "author", "title", hashed.alias("hash"), F.when(~F.col("gated"), F.col("text")).alias("text"))
    # one pass over the texts: from here on there are only their hashes and runs
    d = dedup.shingle_sets(d, "rec_id", "text", keep=("pref", "literary", "gated", "verdict", "author", "title", "hash"))
    out_gate = d.where("gated").select("rec_id", F.concat(F.lit("gate_"), "verdict").alias("decision"), F.lit(None).cast("long").alias("root_id"))
    live = dedup.keep_first(d.where("not gated").select("rec_id", "pref", "hash"), "hash", ["pref", "rec_id"])
    live = cut(live.select("rec_id", F.col("root.rec_id").alias("rep"), "is_first"), "live")
    sets = d.where("not gated").join(live.where("not is_first").select("rec_id"), "rec_id", "left_anti").select("rec_id", "pref", "literary", "author", "title", "sh", "n")
    near = dedup.jaccard_pairs(sets.select("rec_id", "sh", "n"), "rec_id", p.near).select("a", "b", F.lit("near_dup").alias("why"))
    info = sets.select("rec_id", "pref", "author", "title", "literary")
    if collisions is not None:
        near = _without_distinct(near, info, collisions)
    title = normal_title(without_author(nfc(F.col("title")), F.col("author")))
    work = sets.where("literary and author is not null and title is not null").withColumn("work", title).where("work <> ''")
    twice = work.groupBy("author", "work").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    work = work.join(twice, ["author", "work"], "left_semi")
    same = dedup.containment_pairs(work, "rec_id", p.identity, part=["author", "work"]).select("a", "b", F.lit("registry_identity").alias("why"))
    pairs = near.union(same)
    order = lambda x: info.select(F.col("rec_id").alias(x), F.col("pref").alias(f"p{x}"))
    e = pairs.join(order("a"), "a").join(order("b"), "b")
    first = F.col("pa") < F.col("pb")
    e = cut(e.select(F.when(first, F.col("pa")).otherwise(F.col("pb")).alias("early"), F.when(first, F.col("pb")).otherwise(F.col("pa")).alias("late"), "why").distinct(), "ties")
    fate = cut(dedup.greedy_keep(info.select(F.col("pref").alias("node")), e), "fate")
    kept = fate.where("kept").select(F.col("node").alias("early"))
    why = e.join(kept, "early").groupBy(F.col("late").alias("pref")).agg(F.max("why").alias("why"), F.min("early").alias("root"))
    who = info.select(F.col("pref").alias("root"), F.col("rec_id").alias("root_id"))
    fate = fate.select(F.col("node").alias("pref"), "kept").join(why, "pref", "left").join(info.select("pref", "rec_id"), "pref").join(who, "root", "left")
    fate = fate.select("rec_id", F.when(F.col("kept"), "kept").otherwise(F.col("why")).alias("fate"), F.when(~F.col("kept"), F.col("root_id")).alias("root_id"))
    fate = cut(fate, "fates")
    held = contained(sets.join(fate.where("fate = 'kept'").select("rec_id"), "rec_id", "left_semi"), p).where("verdict = 'drop'").select("rec_id", F.col("container").alias("c_root"))
    fate = fate.join(held, "rec_id", "left").select(F.col("rec_id").alias("rep"), F.when(F.col("c_root").isNotNull(), "containment").otherwise(F.col("fate")).alias("fate"), F.coalesce("c_root", "root_id").alias("root_id"))
    copy = live.join(fate, "rep").select(
        "rec_id",
        F.when(F.col("is_first"), F.col("fate")).when(F.col("fate").isin("kept", "containment"), "exact_dup").otherwise(F.col("fate")).alias("decision"),
        F.when(~F.col("is_first") & F.col("fate").isin("kept", "containment"), F.col("rep")).otherwise(F.col("root_id")).alias("root_id"),
    )
    out = out_gate.union(copy)
    return out if wrong is None else out.union(wrong.select("rec_id", F.lit("not_by_author"), F.lit(None).cast("long")))


def unfired(flagged: DataFrame, docs: DataFrame) -> DataFrame:
    """Flagged works (author, title) that no record matches: exclusions that do nothing."""
    have = docs.select("author", _work(F.col("author"), F.col("title")).alias("work")).distinct()
    return flagged.withColumn("work", _work(F.col("author"), F.col("title"))).join(have, ["author", "work"], "left_anti").select("author", "title")


def cross_author(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """(rec_id, root_id, decision, author, root_author, title) of the records dropped for one that stands under another author."""
    a = docs.select("rec_id", "author", "title")
    b = docs.select(F.col("rec_id").alias("root_id"), F.col("author").alias("root_author"))
    return decided.where("root_id is not null").join(a, "rec_id").join(b, "root_id").where(~F.col("author").eqNullSafe(F.col("root_author"))).select("rec_id", "root_id", "decision", "author", "root_author", "title")


def conflicts(cross: DataFrame, collisions: DataFrame) -> DataFrame:
    """(root_id, attributions) of kept records that the collision table gives to more than one author."""
    given = collisions.where("attribution is not null").select(normal_title(nfc(F.col("title"))).alias("t"), "attribution").distinct()
    j = cross.withColumn("t", normal_title(nfc(F.coalesce("title", F.lit(""))))).join(given, "t")
    return j.groupBy("root_id").agg(F.array_sort(F.collect_set("attribution")).alias("attributions")).where(F.size("attributions") > 1)


def _without_distinct(near: DataFrame, info: DataFrame, collisions: DataFrame) -> DataFrame:
    """Near pairs without those of two authors whose title is known to be shared by distinct works."""
    apart = collisions.where("resolution = 'distinct'").select(normal_title(nfc(F.col("title"))).alias("t")).distinct()
    named = info.select("rec_id", "author", normal_title(nfc(F.coalesce("title", F.lit("")))).alias("t"))
    a, b = named.select(F.col("rec_id").alias("a"), F.col("author").alias("xa"), F.col("t").alias("ta")), named.select(F.col("rec_id").alias("b"), F.col("author").alias("xb"), F.col("t").alias("tb"))
    j = near.join(a, "a").join(b, "b").withColumn("t", F.explode(F.array_distinct(F.array("ta", "tb")))).where(~F.col("xa").eqNullSafe(F.col("xb"))).join(apart, "t", "left_semi").select("a", "b").distinct()
    return near.join(j, ["a", "b"], "left_anti")


def contained(sets: DataFrame, p: MergeParams = MergeParams()) -> DataFrame:
    """(rec_id, container, score, verdict): for each smaller literary work the container of the same author and another title that holds most of it, where that is more than `partly`."""
    lit = sets.where("literary and author is not null").select("rec_id", "author", "title", "sh", "n")
    lit = lit.join(lit.where(f"n >= {p.container}").select("author").distinct(), "author", "left_semi")
    pairs = dedup.containment_pairs(lit, "rec_id", p.partly, part=["author"], inner=f"n < {p.container}", outer=f"n >= {p.container}")
    titled = lambda x: lit.select(F.col("rec_id").alias(x), F.col("title").alias(f"t{x}"))
    other = pairs.join(titled("a"), "a").join(titled("b"), "b").where("ta is distinct from tb")
    best = other.groupBy("a").agg(F.max_by("b", F.struct("containment", -F.col("b"))).alias("container"), F.max("containment").alias("score"))
    return best.select(F.col("a").alias("rec_id"), "container", "score", containment_verdict(F.col("score"), p).alias("verdict"))


def survivors(docs: DataFrame, decided: DataFrame, collisions: DataFrame | None = None) -> DataFrame:
    """The kept records in the corpus' schema, with the attribution the collision table gives to texts that other authors' shards repeat."""
    d = docs.join(decided.where("decision = 'kept'").select("rec_id"), "rec_id", "left_semi")
    out = d.select("rec_id", "title", "url", "text", F.length("text").cast("long").alias("n_chars"), "source", "author")
    if collisions is None:
        return out
    given = collisions.where("attribution is not null").select(normal_title(nfc(F.col("title"))).alias("t"), "attribution")
    cross = decided.where("root_id is not null").join(docs.select("rec_id", F.col("author").alias("xa"), normal_title(nfc(F.col("title"))).alias("t")), "rec_id").join(given, "t")
    cross = cross.join(docs.select(F.col("rec_id").alias("root_id"), F.col("author").alias("xb")), "root_id").where(~F.col("xa").eqNullSafe(F.col("xb")))
    last = cross.groupBy("root_id").agg(F.max_by("attribution", "rec_id").alias("given"))
    return out.join(last.withColumnRenamed("root_id", "rec_id"), "rec_id", "left").withColumn("author", F.coalesce("given", "author")).drop("given")
