"""Near-duplicate records with small edits.

One pass gives every text a fingerprint of its words and a BagMinHash signature of its word shingles. Texts of the same words
form a class; the smallest id stands for it. Bands of the signature are joined to candidate pairs, whose texts are fetched and
compared by all their shingles, as 64-bit hashes. Nothing is capped. A bucket of more than `hot` texts, as boilerplate makes
them, is not joined with itself: its texts are compared by their rarest shingles, of which a pair must share one, so that what most
of them have makes no candidates; no pair is missed by that.

With bands of r components each, a pair of similarity s is missed with probability (1 - s**r)**bands: at the defaults 0.1 % at
0.5, none to speak of at 0.6 and above.

Nulls: null ids and null or blank texts are no case, nor are texts of fewer words than a shingle has. Repeated ids must not
occur. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zrno.llm import grams
from zrno.operators import dedup
from zrno.operators.components import connected_components
from zrno.session import cut


def _sign(k: int, bands: int, rows: int, weighted: bool):
    schema = pa.schema([("id", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = grams.Hashes()
        for b in grams.chunks(batches, 1):
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            words, n = grams.word_hashes(texts, cache)
            ends = np.cumsum(n)
            doc, h = grams.shingles(words, n, k)
            doc, h, weight = grams.distinct(doc, h)
            sig = grams.bag_minhash(doc, h, weight if weighted else np.ones(len(h), np.int64), len(n), bands * rows).view(np.uint64)
            ok = np.flatnonzero(n >= k)
            sig = sig[ok]
            band = np.empty((len(ok), bands), np.uint64)
            for j in range(bands):
                x = np.full(len(ok), j * 2 + 1, np.uint64)
                for i in range(rows):
                    x = grams.mix(x ^ sig[:, j * rows + i])
                band[:, j] = x
            raw = words.tobytes()
            fps = [xxhash.xxh3_128_digest(raw[8 * (ends[i] - n[i]) : 8 * ends[i]]) for i in ok]
            flat = pa.array(band.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ok) * bands + 1, bands), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids[ok].astype(np.int64)), pa.array(fps, pa.binary()), lists], schema=schema)

    return run


def pack(df: DataFrame) -> DataFrame:
    """(id, z): texts compressed for shuffling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()], pa.binary())], names=["id", "z"])

    return df.mapInArrow(run, "id long, z binary")


def unpack(d: zstandard.ZstdDecompressor, z: bytes) -> str:
    return d.decompress(z).decode("utf-8", "surrogatepass")


def _verify(k: int, least: float, weighted: bool):
    """Exact similarity of the pairs of a batch; every text of it is cut into shingles once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, d = grams.Hashes(), zstandard.ZstdDecompressor()
        for b in grams.chunks(grams.chunks(batches, 2, 400_000), 3, 400_000):
            a_id, b_id = b.column(0).to_numpy(), b.column(1).to_numpy()
            ids, at = np.unique(np.concatenate([a_id, b_id]), return_inverse=True)
            z = [None] * len(ids)
            for i, x in zip(at, b.column(2).to_pylist() + b.column(3).to_pylist()):
                z[i] = x
            words, n = grams.word_hashes((unpack(d, x) for x in z), cache)
            doc, h, weight = grams.distinct(*grams.shingles(words, n, k))
            if not weighted:
                weight = np.ones(len(h), np.int64)
            lo = np.searchsorted(doc, np.arange(len(ids) + 1))
            m = len(a_id)
            both, either = np.zeros(m), np.zeros(m)
            for p in range(m):
                i, j = at[p], at[m + p]
                x, y = h[lo[i] : lo[i + 1]], h[lo[j] : lo[j + 1]]
                wx, wy = weight[lo[i] : lo[i + 1]], weight[lo[j] : lo[j + 1]]
                pos = np.searchsorted(y, x)
                pos[pos == len(y)] = 0
                hit = y[pos] == x if len(y) else np.zeros(len(x), bool)
                both[p] = np.minimum(wx[hit], wy[pos[hit]]).sum()
                either[p] = wx.sum() + wy.sum() - both[p]
            sim = both / np.maximum(either, 1)
            ok = sim >= least
            yield pa.RecordBatch.from_arrays([pa.array(a_id[ok]), pa.array(b_id[ok]), pa.array(sim[ok])], names=["a", "b", "similarity"])

    return run


def _sets(k: int, weighted: bool):
    """(id, sh, n): shingles as 64-bit hashes, the second and further occurrences as elements of their own where weighted, so that the Jaccard similarity of sets is that of bags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = grams.Hashes()
        for b in grams.chunks(batches, 1):
            words, n = grams.word_hashes(b.column(1).to_pylist(), cache)
            doc, h, weight = grams.distinct(*grams.shingles(words, n, k))
            if weighted:
                at = np.repeat(np.arange(len(h)), weight)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
                doc, h = doc[at], np.where(nth == 0, h[at], grams.mix(h[at] + nth.astype(np.uint64)))
            size = np.bincount(doc, minlength=len(n))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(size.astype(np.int32))], names=["id", "sh", "n"])

    return run


def near_pairs(df: DataFrame, key: str, text: str, least: float = 0.8, k: int = 5, bands: int = 24, rows: int = 2, weighted: bool = True, hot: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): classes (id, class_id) of every text that has a shingle, by same words; pairs (a, b, similarity) of class ids, a < b, at or above `least`.

    weighted: compare bags of shingles (sum of the lesser over sum of the greater multiplicities), else sets.
    """
    d = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null and text <> ''")
    signed = cut(d.mapInArrow(_sign(k, bands, rows, weighted), "id long, fp binary, bands array<long>"), "signed")
    reps = signed.groupBy("fp").agg(F.min("id").alias("class_id"))
    classes = cut(signed.select("id", "fp").join(reps, "fp").select("id", "class_id"), "classes")
    heads = classes.where("id = class_id").select("id")
    b = signed.join(heads, "id", "left_semi").select("id", F.explode("bands").alias("band"))
    full = cut(b.groupBy("band").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "bands")
    cold = cut(b.join(full.where(f"many <= {hot}"), "band", "left_semi"), "banded")
    pairs = cold.alias("l").join(cold.alias("r"), F.expr("l.band = r.band and l.id < r.id")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    crowded = full.where(f"many > {hot}")
    if not crowded.isEmpty():
        ids = cut(b.join(crowded, "band", "left_semi").select("id").distinct(), "crowded")
        sets = cut(d.select("id", "text").join(ids, "id", "left_semi").mapInArrow(_sets(k, weighted), "id long, sh array<long>, n int"), "sets")
        pairs = pairs.union(dedup.jaccard_candidates(sets, "id", least))
    pairs = cut(pairs.distinct(), "candidates")
    z = pack(d.select("id", "text"))
    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    z = cut(z.join(need, "id", "left_semi"), "texts")
    texts = pairs.join(z.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").join(z.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
    sure = texts.select("a", "b", "za", "zb").mapInArrow(_verify(k, least, weighted), "a long, b long, similarity double")
    return classes, cut(sure, "near")


def exact_pairs(df: DataFrame, key: str, text: str, least: float = 0.8, k: int = 5, weighted: bool = True) -> DataFrame:
    """(a, b, both, similarity) of all pairs of texts by their shingles alone, to measure signatures against."""
    d = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null and text <> ''")
    sets = cut(d.mapInArrow(_sets(k, weighted), "id long, sh array<long>, n int"), "sets")
    return dedup.jaccard_pairs(sets.where("n > 0"), "id", least)


def expand(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): pairs of records from pairs of classes, and those within a class; where the result must hold pairs."""
    c = classes.select(F.col("class_id").alias("ca"), F.col("id").alias("ia"))
    e = classes.select(F.col("class_id").alias("cb"), F.col("id").alias("ib"))
    across = pairs.select(F.col("a").alias("ca"), F.col("b").alias("cb")).join(c, "ca").join(e, "cb")
    within = c.join(e, F.expr("ca = cb and ia < ib"))
    return across.union(within.select("cb", "ca", "ia", "ib")).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


def groups(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, group_id, links): one row for each text; links counts the other classes its own is similar to."""
    g = connected_components(pairs, "a", "b")
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    j = classes.join(g.withColumnRenamed("node", "class_id"), "class_id", "left").join(links, "class_id", "left")
    return j.select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
