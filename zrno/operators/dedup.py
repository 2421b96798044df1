"""Exact, near and contained duplicates.

Similarity joins are exact: texts are sets of hashed runs of words, and a pair can only reach the threshold if it shares one of
the rarest runs of the smaller (prefix filtering), so common runs never meet. Nothing is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zrno.operators.components import connected_components
from zrno.session import cut


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def keep_first(df: DataFrame, same: str, order: list[str]) -> DataFrame:
    """Adds `root` (order key of the first row of the same content, as a struct) and `is_first`. Aggregates before it joins, so a content of very many rows is no single task's burden. A null content is like no other."""
    key = F.struct(*order)
    first = df.where(F.col(same).isNotNull()).groupBy(same).agg(F.min(key).alias("root"))
    return df.join(first, same, "left").withColumn("root", F.coalesce("root", key)).withColumn("is_first", F.col("root") == key)


_WORD = re.compile(r"\w+")
_FOLD = str.maketrans({"ß": "ss", "ſ": "s", "ς": "σ"})


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC6A4A7935BD1E995)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def _runs(k: int):
    """Distinct hashes of the runs of k words of each text of a batch, all computed at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _Words().__getitem__
        for b in batches:
            parts = [_WORD.findall(t.lower().translate(_FOLD)) if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
            n = np.array([len(w) for w in parts], np.int64)
            words = np.fromiter((get(w) for ws in parts for w in ws), np.uint64, int(n.sum()))
            docs = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
            h = np.zeros(len(words), np.uint64)
            size = np.minimum(n, k)  # a text of fewer words is one run
            for i in range(k):
                at = np.minimum(np.arange(len(words)) + i, max(0, len(words) - 1))
                h = np.where(i < size[docs], _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[at]), h)
            ok = place <= (n - size)[docs]
            docs, h = docs[ok], h[ok]
            o = np.lexsort((h, docs))
            docs, h = docs[o], h[o]
            new = np.append(True, (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])) if len(h) else np.empty(0, bool)
            docs, h = docs[new], h[new]
            many = np.bincount(docs, minlength=len(n))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, pa.array(many.astype(np.int32))], names=[*b.schema.names[:-1], "sh", "n"])

    return run


def shingle_sets(docs: DataFrame, key: str, text: str, k: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, sh array<long>, n): distinct runs of k words as 64-bit hashes, by whole Arrow batches; a text of fewer words is one run, one without words has none. Similarity is that of the hashes."""
    d = docs.select(key, *keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{c}` {t}" for c, t in d.dtypes if c != "_text")
    return cut(d.mapInArrow(_runs(k), f"{fields}, sh array<long>, n int"), "shingles")


def ordered_runs(sets: DataFrame, key: str, part: list[str]) -> DataFrame:
    """(key, n, x): each set's runs that stand in other sets of its part too, as structs (df, s), rarest first. Ties go by the run, so all sets have one order. A part's run is one number: nothing else is shuffled."""
    runs = F.transform("sh", lambda s: F.xxhash64(*part, s)) if part else F.col("sh")
    each = sets.select(key, "n", F.explode(runs).alias("s"))
    df = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(df, "s")  # runs that stand in one set only can't match
    return cut(shared.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("x"), F.first("n").alias("n")), "ordered")


def _prefix(have: DataFrame, key: str, need: Column) -> DataFrame:
    """(key, n, i, s): the runs of which one must be shared where `need` of them must; i counts from one in the order of rarity, runs of no other set first."""
    own = F.col("n") - F.size("x")
    take = (F.col("n") - need + 1 - own).cast("int")
    d = have.where(take > 0).select(key, "n", own.alias("own"), F.posexplode(F.slice("x", F.lit(1), F.greatest(take, F.lit(0)))).alias("i", "y"))
    return d.select(key, "n", (F.col("own") + F.col("i") + 1).alias("i"), F.col("y.s").alias("s"))


def jaccard_candidates(sets: DataFrame, key: str, least: float) -> DataFrame:
    """(a, b), a < b: all pairs that can reach `least`, and few others: both have one of the runs of their prefixes, sizes fit, and what is left after the place of the run is enough for the overlap that is needed."""
    pre = cut(_prefix(ordered_runs(sets, key, []), key, F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9))), "prefixes")
    l = pre.select(F.col(key).alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), "s")
    r = pre.select(F.col(key).alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), "s")
    # of the first run that both have, the greatest overlap is one and all that follows in the shorter rest
    fits = F.expr(f"a < b and least(na, nb) >= {least} * greatest(na, nb) - 1e-9 and 1 + least(na - ia, nb - ib) >= {least / (1 + least)} * (na + nb) - 1e-9")
    return l.join(r, "s").where(fits).select("a", "b").distinct()


def jaccard_pairs(sets: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """(a, b, both, similarity), a < b, of all pairs of shingle_sets() at or above `least`."""
    cand = jaccard_candidates(sets, key, least)
    return _measure(cand, sets, key).withColumn("similarity", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).where(F.col("similarity") >= least).select("a", "b", "both", "similarity")


def _measure(cand: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """Candidates with the sizes and the overlap of their sets; only sets of candidates travel."""
    cand = cut(cand, "candidates")
    need = cand.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    some = cut(sets.select(key, "sh", "n").join(need, key, "left_semi"), "compared")
    a = some.select(F.col(key).alias("a"), F.col("sh").alias("sa"), F.col("n").alias("na"))
    b = some.select(F.col(key).alias("b"), F.col("sh").alias("sb"), F.col("n").alias("nb"))
    return cand.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("sa", "sb"))).drop("sa", "sb")


def containment_pairs(sets: DataFrame, key: str, least: float = 0.5, part: list[str] | None = None, inner: str = "true", outer: str = "true") -> DataFrame:
    """(a, b, both, containment): how much of a stands in b, for all ordered pairs at or above `least`, within equal `part` columns; inner, outer: conditions on the number n of runs of a and of b."""
    have = ordered_runs(sets, key, part or [])
    pre = _prefix(have.where(inner), key, F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)))
    every = have.where(outer).select(key, F.size("x").alias("k"), F.posexplode("x").alias("i", "y")).select(F.col(key).alias("b"), (F.col("k") - F.col("i")).alias("rest"), F.col("y.s").alias("s"))
    l = pre.select(F.col(key).alias("a"), F.col("n").alias("na"), "s")
    fits = F.expr(f"a <> b and rest >= {least} * na - 1e-9")  # the first run that both have, and all that follows it in b
    cand = l.join(every, "s").where(fits).select("a", "b").distinct()
    return _measure(cand, sets, key).withColumn("containment", F.col("both") / F.col("na")).where(F.col("containment") >= least).select("a", "b", "both", "containment")


def greedy_keep(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, kept, root) of a first-come selection over nodes in their order: a node is dropped if any earlier neighbour is kept.

    edges: (early, late), early < late. In each round nodes whose earlier neighbours are all dropped are kept, and nodes with a kept
    earlier neighbour are dropped; rounds are as many as the longest chain of decisions, and each settles one node at least, the earliest
    open one. Nodes without edges never enter a round.
    """
    every = e = cut(edges.select("early", "late").distinct(), "edges")
    open_ = cut(e.select(F.explode(F.array("early", "late")).alias("node")).distinct(), "open")
    done: DataFrame | None = None
    while not open_.isEmpty():
        waiting = e.join(open_.select(F.col("node").alias("early")), "early", "left_semi").select(F.col("late").alias("node")).distinct()
        kept = cut(open_.join(waiting, "node", "left_anti"), "kept")
        hit = e.join(kept.select(F.col("node").alias("early")), "early").join(open_.select(F.col("node").alias("late")), "late", "left_semi")
        dropped = hit.select(F.col("late").alias("node")).distinct()
        step = kept.select("node", F.lit(True).alias("kept")).union(dropped.select("node", F.lit(False).alias("kept")))
        done = cut(step if done is None else done.union(step), "done")
        open_ = cut(open_.join(done, "node", "left_anti"), "open")
        e = cut(e.join(open_.select(F.col("node").alias("late")), "late", "left_semi").select("early", "late"), "edges")
    if done is None:
        return nodes.select("node", F.lit(True).alias("kept"), F.col("node").alias("root"))
    of = every.join(done.where("kept").select(F.col("node").alias("early")), "early").groupBy(F.col("late").alias("node")).agg(F.min("early").alias("root"))
    out = nodes.join(done, "node", "left").join(of, "node", "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
    return out.select("node", "kept", F.when(F.col("kept"), F.col("node")).otherwise(F.col("root")).alias("root"))


def cluster(pairs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, cluster): the smallest key each is tied to through pairs (a, b)."""
    g = connected_components(pairs).withColumnRenamed("node", key)
    return nodes.select(key).distinct().join(g, key, "left").select(key, F.coalesce("component", key).alias("cluster"))


def band_hashes(sets: DataFrame, key: str, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """(key, band hash), a row for each band of each set that isn't empty. The MinHash signature, `bands` x `rows` minima of re-hashed elements, is made for whole Arrow batches at once."""
    d = sets.where("n > 0").select(key, "sh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            size = np.diff(lists.offsets.to_numpy())
            h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
            out = []
            for j in range(bands):
                band = np.full(len(size), j, np.uint64)
                for i in range(rows):
                    low = np.minimum.reduceat(_mixed(h + np.uint64((seed + j * rows + i) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), starts)
                    band = _mixed(band * np.uint64(31) + low)
                out.append(band)
            flat = np.stack(out, axis=1).reshape(-1).view(np.int64) if len(size) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(size)), bands))), pa.array(flat)], names=[key, "h"])

    return d.mapInArrow(run, f"`{key}` {dict(d.dtypes)[key]}, h long")


def lsh_index(sets: DataFrame, key: str, bands: int = 21, rows: int = 6) -> DataFrame:
    """(key, sh, n, bands): sets with their band hashes, to be kept and matched against; more are added by union."""
    b = band_hashes(sets, key, bands, rows).groupBy(key).agg(F.collect_list("h").alias("bands"))
    return cut(sets.where("n > 0").select(key, "sh", "n").join(b, key), "index")


def lsh_match(index: DataFrame, sets: DataFrame, key: str, least: float = 0.8, bands: int = 21, rows: int = 6, earlier: bool = False) -> DataFrame:
    """(key, root_id) of every set: the smallest other key of the index that it is similar to at `least` or more, null for none; candidates are compared by their runs. earlier: only smaller keys than its own."""
    new = cut(band_hashes(sets, key, bands, rows), "bands")
    old = index.select(F.col(key).alias("b"), F.explode("bands").alias("h"))
    cand = new.select(F.col(key).alias("a"), "h").join(old, "h").where("a > b" if earlier else "a <> b").select("a", "b").distinct()
    every = sets.select(key, "sh", "n").unionByName(index.select(key, "sh", "n")).dropDuplicates([key])
    m = _measure(cand, every, key).where(F.col("both") >= F.lit(least) * (F.col("na") + F.col("nb") - F.col("both")) - 1e-9)
    return sets.select(key).join(m.groupBy(F.col("a").alias(key)).agg(F.min("b").alias("root_id")), key, "left")


def lsh_pairs(sets: DataFrame, key: str, least: float = 0.8, bands: int = 21, rows: int = 6) -> DataFrame:
    """(a, b), a < b: pairs whose signatures agree in a band and that are similar to `least` or more by their runs; one of similarity s is found with the chance 1 - (1 - s**rows)**bands."""
    b = cut(band_hashes(sets, key, bands, rows), "bands")
    b = cut(b.join(b.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "h", "left_semi"), "shared")
    cand = b.select(F.col(key).alias("a"), "h").join(b.select(F.col(key).alias("b"), "h"), "h").where("a < b").select("a", "b").distinct()
    return _measure(cand, sets, key).where(F.col("both") >= F.lit(least) * (F.col("na") + F.col("nb") - F.col("both")) - 1e-9).select("a", "b")


def most_contained(sets: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """(key, max_containment) of the sets whose keys are in `some`: how much of each stands in the one other set that holds most of it.

    Only runs of those sets are looked up in the others, and only overlaps are counted; no pair of sets is ever gathered.
    """
    own = sets.where("n > 0").join(some, key, "left_semi")
    l = own.select(F.col(key).alias("h"), F.explode("sh").alias("s"))
    runs = cut(l.groupBy("s").agg(F.count(F.lit(1)).alias("k")).select("s"), "runs")
    r = sets.select(F.col(key).alias("b"), F.explode("sh").alias("s")).join(runs, "s", "left_semi")
    both = l.join(r, "s").where("b <> h").groupBy("h", "b").agg(F.count(F.lit(1)).alias("both"))
    best = both.groupBy(F.col("h").alias(key)).agg(F.max("both").alias("both"))
    return own.join(best, key, "left").select(key, F.coalesce(F.col("both") / F.col("n"), F.lit(0.0)).alias("max_containment"))
