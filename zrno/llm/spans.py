"""Long exact spans shared between records.

Windows are runs of `span` code points. Within a window the smallest hash of its runs of `mini` code points is its minimiser;
consecutive windows of the same minimiser make a super-k-mer. A first pass lists every text's super-k-mers as (minimiser, digest of the
string, start, number of windows). Only minimisers that two or more different texts have can hold a shared window. Where all
their strings are the same, nothing has to travel; else each distinct string goes once, packed with its minimiser, to the
bucket, where all windows are hashed and sorted, and runs of equal hashes are checked against the strings. Which texts have a
string is a table that is joined afterwards, so a passage that very many texts have is one string in its bucket.

A minimiser of more than `hot` different strings is split: its super-k-mers are cut again by a second minimiser, which equal windows
share too, so its windows are spread over many buckets.

What comes out is linear: groups (g, id) of texts that share a window, one for each distinct set of texts; or stretches of each text
that stand elsewhere too. Pairs are made of groups where a result must hold pairs.

Texts equal as a whole are one class with the smallest id in front; their members are paired at the end. Nothing is capped. Equal
texts are told by 128-bit digests, equal strings by their minimiser and a 64-bit digest, sets of texts by two 64-bit sums modulo two.

Nulls: null ids, null texts and texts shorter than a window are no case. Repeated ids must not occur. Empty tables give empty
results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zrno.llm import grams
from zrno.llm.near import pack, unpack
from zrno.session import cut


#: Marks a super-k-mer whose minimiser the text has had before.
AGAIN = 1 << 62


def _super(codes: np.ndarray, n: np.ndarray, span: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, number of windows) of the super-k-mers of texts whose windows have the minimisers `best`; positions are those of `codes`."""
    ends, m = np.cumsum(n), len(best)
    doc = np.repeat(np.arange(len(n)), n)
    inside = doc[:m] == doc[span - 1 : span - 1 + m] if m else np.empty(0, bool)
    new = inside.copy()
    if m:
        new[1:] &= (best[1:] != best[:-1]) | ~inside[:-1] | (doc[1:m] != doc[: m - 1])
        new |= inside & ((np.arange(m) - (ends - n)[doc[:m]]) % 0x8000 == 0)  # the count has 16 bits
    start = np.flatnonzero(new)
    of = doc[start]
    # windows of a super-k-mer: up to the next one's start or the text's last window
    return of, start, np.minimum(np.append(start[1:], m), ends[of] - span + 1) - start


def _list(span: int, mini: int):
    """Super-k-mers of every text of a batch, all computed at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grams.chunks(batches, 1):
            texts = b.column(1).to_pylist()
            codes, n = grams.code_points(texts)
            best = grams.window_minima(grams.mix(grams.window_hashes(codes, mini)), span - mini + 1)
            of, start, count = _super(codes, n, span, best)
            ok = np.flatnonzero(n >= span)
            at = start - (np.cumsum(n) - n)[of]
            cuts = pa.array(np.searchsorted(of, np.append(ok, len(n))), pa.int32())
            raw = codes.tobytes()
            sids = np.fromiter((xxhash.xxh3_64_intdigest(raw[4 * i : 4 * (i + k + span - 1)]) for i, k in zip(start.tolist(), count.tolist())), np.uint64, len(start)).view(np.int64)
            keys = best[start].view(np.int64) if len(best) else np.empty(0, np.int64)
            o = np.lexsort((at, keys, of))
            again = np.append(False, (keys[o][1:] == keys[o][:-1]) & (of[o][1:] == of[o][:-1])) if len(o) else np.empty(0, bool)
            spots = (at << 16 | count).astype(np.int64)
            spots[o[again]] |= AGAIN
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (keys, spots, sids)]
            fps = [xxhash.xxh3_128_digest(texts[i].encode("utf-8", "surrogatepass")) for i in ok]
            ids = b.column(0).to_numpy(zero_copy_only=False)[ok].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fps, pa.binary()), pa.array(n[ok]), *lists], names=["id", "fp", "n", "keys", "spots", "sids"])

    return run


def _slice(span: int, mini: int):
    """(bucket, key, sid, base, lo, hi, s): the strings of the listed super-k-mers of each text; those of hot minimisers cut again by the second one."""

    def again(key: int, t: str) -> Iterator[tuple[int, int, str]]:
        codes, n = grams.code_points([t])
        h = grams.mix(grams.window_hashes(codes, mini))
        second = grams.mix(h ^ np.uint64(0xA0761D6478BD642F))
        second[h == np.uint64(key & 0xFFFFFFFFFFFFFFFF)] = np.iinfo(np.uint64).max  # what all of the bucket have tells nothing apart
        best = grams.window_minima(second, span - mini + 1)
        _, start, count = _super(codes, n, span, best)
        keys = grams.mix(best[start] ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
        for k, p, c in zip(keys.tolist(), start.tolist(), count.tolist()):
            yield k, p, t[p : p + c - 1 + span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for z, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = unpack(d, z)
                for x in at:
                    p, c = (x["spot"] & ~AGAIN) >> 16, x["spot"] & 0xFFFF
                    s = t[p : p + c - 1 + span]
                    for k, base, part in again(x["key"], s) if x["hot"] else ((x["key"], 0, s),):
                        for col, v in zip(out, (k, x["key"], x["sid"], base, x["lo"], x["hi"], part)):
                            col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(out, types)], names=["bucket", "key", "sid", "base", "lo", "hi", "s"])

    return run


def _whole_buckets(batches: Iterator[pa.RecordBatch], least: int = 6_000) -> Iterator[pa.Table]:
    """Tables that hold whole buckets (rows of equal key come together), of `least` rows or more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        t = pa.Table.from_batches(held)
        k = t.column(0).to_numpy()
        other = np.flatnonzero(k != k[-1])
        end = int(other[-1]) + 1 if len(other) else 0
        if end:
            yield t.slice(0, end)
        held = t.slice(end).to_batches()
        n = t.num_rows - end
    if held:
        yield pa.Table.from_batches(held)


def equal_windows(keys: np.ndarray, strings: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string number, offset, run) of all windows, sorted by run and string; windows of one run are equal, by hash and by their characters."""
    codes, n = grams.code_points(strings)
    h = grams.window_hashes(codes, span)
    row = np.repeat(np.arange(len(n)), n)
    m = len(h)
    at = np.flatnonzero(row[:m] == row[span - 1 : span - 1 + m]) if m else np.empty(0, np.int64)
    row = row[at]
    h = grams.mix(h[at] ^ keys.view(np.uint64)[row])
    o = np.lexsort((at, h))
    row, at, h = row[o], at[o], h[o]
    first = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
    run = np.cumsum(first) - 1
    lead = at[np.flatnonzero(first)][run] if len(h) else at
    # a window whose neighbour to the left has the neighbour of its leader for a leader needs its last character compared only
    by = np.argsort(at)
    x, y = at[by], lead[by]
    follows = np.append(False, (x[1:] == x[:-1] + 1) & (y[1:] == y[:-1] + 1) & (row[by][1:] == row[by][:-1])) if len(x) else np.empty(0, bool)
    same = codes[x + span - 1] == codes[y + span - 1] if len(x) else np.empty(0, bool)
    whole = np.flatnonzero(~follows & (x != y))
    for i in range(0, len(whole), 4096):
        k = whole[i : i + 4096]
        same[k] = (codes[x[k][:, None] + np.arange(span)] == codes[y[k][:, None] + np.arange(span)]).all(1)
    if not same.all():  # a window after one that differs has been compared with a leader it may not share, so all of these runs are told apart by their strings
        bad = np.isin(run, np.unique(run[by][~same]))
        told: dict[tuple[int, bytes], int] = {}
        top = int(run[-1]) + 1
        for k in np.flatnonzero(bad):
            run[k] = told.setdefault((int(run[k]), codes[at[k] : at[k] + span].tobytes()), top + len(told))
        o = np.lexsort((at, run))
        row, at, run = row[o], at[o], run[o]
    return row, at - (np.cumsum(n) - n)[row], run


def _groups(span: int):
    """(g, key, sid): the strings of each set that an equal window shows, each distinct set of a bucket once; sets of one string are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_buckets(batches):
            keys, own, sids = (t.column(k).to_numpy() for k in range(3))
            row, off, no = equal_windows(keys, t.column(6).to_pylist(), span)
            one = np.append(True, (no[1:] != no[:-1]) | (row[1:] != row[:-1])) if len(no) else np.empty(0, bool)
            row, no = row[one], no[one]
            at = np.flatnonzero(np.append(True, no[1:] != no[:-1])) if len(no) else np.empty(0, np.int64)
            size = np.diff(np.append(at, len(no)))
            total = np.concatenate([[np.uint64(0)], np.cumsum(grams.mix(row.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)])
            sets, keep = np.unique((total[at + size] - total[at]) ^ grams.mix(size.astype(np.uint64)), return_index=True)
            many = size[keep] > 1
            keep = keep[many]
            g = grams.mix(sets[many] ^ keys.view(np.uint64)[row[at[keep]]]).view(np.int64) if len(keep) else np.empty(0, np.int64)
            k = np.repeat(np.arange(len(keep)), size[keep])
            where = at[keep][k] + np.arange(len(k)) - np.repeat(np.cumsum(size[keep]) - size[keep], size[keep])
            yield pa.RecordBatch.from_arrays([pa.array(g[k]), pa.array(own[row[where]]), pa.array(sids[row[where]])], names=["g", "key", "sid"])

    return run


def _stretches(span: int):
    """(key, sid, from, to): stretches of each string whose windows stand in another text too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_buckets(batches):
            keys, own, sids, base, low, high = (t.column(k).to_numpy() for k in range(6))
            row, off, no = equal_windows(keys, t.column(6).to_pylist(), span)
            if not len(no):
                continue
            at = np.flatnonzero(np.append(True, no[1:] != no[:-1]))
            shared = np.repeat(np.minimum.reduceat(low[row], at) != np.maximum.reduceat(high[row], at), np.diff(np.append(at, len(no))))
            row, off = row[shared], off[shared]
            if not len(row):
                continue
            o = np.lexsort((off, row))
            row, off = row[o], off[o]
            at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1)))
            end = np.append(at[1:], len(row)) - 1
            r = row[at]
            yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(sids[r]), pa.array((base[r] + off[at]).astype(np.int64)), pa.array((base[r] + off[end] + span).astype(np.int64))], names=["key", "sid", "lo", "hi"])

    return run


@dataclass
class Parts:
    """classes (id, class_id, n); keys (key, one, x, y): shared minimisers, whether all their strings are the same, and the set of their texts as two sums; members (key, sid, id, spot, one) of class ids; strings (key, sid, lo, hi) of minimisers of several, with the least and greatest text; buckets (bucket, key, sid, base, lo, hi, s), each together."""

    classes: DataFrame
    keys: DataFrame
    members: DataFrame
    strings: DataFrame
    buckets: DataFrame


def _prepare(df: DataFrame, key: str, text: str, span: int, mini: int, hot: int) -> Parts:
    d = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(f"id is not null and length(text) >= {span}")
    listed = cut(d.mapInArrow(_list(span, mini), "id long, fp binary, n long, keys array<long>, spots array<long>, sids array<long>"), "listed")
    heads = listed.groupBy("fp").agg(F.min("id").alias("class_id"))
    classes = cut(listed.select("id", "fp", "n").join(heads, "fp").select("id", "class_id", "n"), "classes")
    copies = classes.where("id <> class_id").select("id")
    each = listed.join(copies, "id", "left_anti")
    shared = each.select("id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    flat = each.select("id", F.explode(F.arrays_zip("keys", "spots", "sids")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.sids").alias("sid"), "id", F.col("x.spots").alias("spot"))
    flat = cut(flat.join(cut(shared, "minimisers"), "key", "left_semi"), "shared")
    first = F.when(F.col("spot") < AGAIN, F.xxhash64("id"))
    keys = flat.groupBy("key").agg((F.min("sid") == F.max("sid")).alias("one"), F.bit_xor(first).alias("x"), F.bit_xor(F.when(F.col("spot") < AGAIN, F.xxhash64("id", F.lit(7)))).alias("y"), (F.count(F.lit(1)) > hot).alias("hot"))
    keys = cut(keys, "keys")
    several = keys.where("not one").select("key", "hot")
    strings = cut(flat.join(several, "key").groupBy("key", "sid", "hot").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min_by("spot", F.struct("id", "spot")).alias("spot")), "strings")
    want = strings.groupBy(F.col("lo").alias("id")).agg(F.collect_list(F.struct("key", "sid", "spot", "lo", "hi", "hot")).alias("at"))
    parts = pack(d).join(cut(want, "wanted"), "id").select("z", "at").mapInArrow(_slice(span, mini), "bucket long, key long, sid long, base int, lo long, hi long, s string")
    return Parts(classes, keys, flat, strings.select("key", "sid", "lo", "hi"), parts.repartition("bucket").sortWithinPartitions("bucket"))


def shared_groups(df: DataFrame, key: str, text: str, span: int = 150, mini: int = 40, hot: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(classes (id, class_id), groups (g, id) of class ids that share a run of `span` or more code points): every two of a group do, and every two that do are in a group."""
    p = _prepare(df, key, text, span, mini, hot)
    # of minimisers of one string, one for each set of texts says it all
    alone = p.keys.where("one").groupBy("x", "y").agg(F.min("key").alias("key")).select("key")
    groups = p.members.join(alone, "key", "left_semi").where(F.col("spot") < AGAIN).select(F.col("key").alias("g"), "id")
    sets = p.buckets.mapInArrow(_groups(span), "g long, key long, sid long")
    same = p.strings.where("lo < hi").select(F.xxhash64("key", "sid").alias("g"), "key", "sid")
    told = cut(sets.union(same).join(p.members, ["key", "sid"]).select("g", "id").distinct(), "told")
    several = told.groupBy("g").agg(F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rest = several.groupBy("x", "y").agg(F.min("g").alias("g")).join(p.keys.where("one").select("x", "y"), ["x", "y"], "left_anti").select("g")
    return p.classes.select("id", "class_id"), cut(groups.union(told.join(rest, "g", "left_semi")), "spans")


def shared_pairs(df: DataFrame, key: str, text: str, span: int = 150, mini: int = 40, hot: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(classes (id, class_id), pairs (a, b) of class ids, a < b, that share a run of `span` or more code points)."""
    classes, groups = shared_groups(df, key, text, span, mini, hot)
    pairs = groups.alias("l").join(groups.alias("r"), F.expr("l.g = r.g and l.id < r.id")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    return classes, pairs.distinct()


def shared_share(df: DataFrame, key: str, text: str, span: int = 150, mini: int = 40, hot: int = 4096) -> DataFrame:
    """(id, n_chars, shared_chars, share): how much of each text of `span` or more code points stands elsewhere too. A text with an exact copy is shared as a whole."""
    p = _prepare(df, key, text, span, mini, hot)
    at = F.shiftright(F.col("spot").bitwiseAND(F.lit(AGAIN - 1)), 16)
    whole = p.members.join(p.keys.where("one").select("key"), "key", "left_semi").select("id", at.alias("lo"), (at + F.expr("spot & 65535") + (span - 1)).alias("hi"))
    s = p.buckets.mapInArrow(_stretches(span), "key long, sid long, lo long, hi long")
    s = s.join(p.members, ["key", "sid"]).select("id", (at + F.col("lo")).alias("lo"), (at + F.col("hi")).alias("hi")).union(whole)
    runs = s.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda acc, r: F.struct((acc.n + F.greatest(F.lit(0), r.hi - F.greatest(r.lo, acc.to))).alias("n"), F.greatest(acc.to, r.hi).alias("to"))
    runs = runs.select(F.col("id").alias("class_id"), F.aggregate("x", start, step).n.alias("covered"))
    size = p.classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("members"))
    j = p.classes.join(size, "class_id").join(runs, "class_id", "left")
    shared = F.when(F.col("members") > 1, F.col("n")).otherwise(F.coalesce("covered", F.lit(0)))
    return j.select("id", F.col("n").alias("n_chars"), shared.cast("long").alias("shared_chars"), (shared / F.col("n")).alias("share"))
