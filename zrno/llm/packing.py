"""Filling fixed-capacity containers with documents.

Documents are dealt to shards by a hash of their id; a shard holds about `docs_per_shard` of them. Within a shard a BM25 inverted
index of the tokenizer's pieces returns, for the largest document left as a seed, all unused documents that share a piece with it; they fill
its container in the order of likeness, each if it fits and leaves room that can still be filled closely, and the space left over takes the
largest unused documents that fit. A document above
the capacity fills containers of its own, and only its rest is packed. Containers left at most half full, at most one for each shard
but for rounding, are merged across shards in a second round.

Nulls: null and empty texts take no space and lie in their shard's first container. Rows with the same id are packed as
documents of their own. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zrno.llm import tokens
from zrno.session import cut


class Pieces(dict):
    """piece -> number; sizes and hashes by number."""

    def __init__(self, sizes: tokens.Sizes) -> None:
        super().__init__()
        self.sizes, self.size, self.hash = sizes, [], []

    def __missing__(self, p: str) -> int:
        k = self[p] = len(self.size)
        self.size.append(len(self.sizes.encoding._encode_single_piece(p.encode("utf-8", "replace"))))
        self.hash.append(xxhash.xxh32_intdigest(p))
        return k


def _vectors(bc):
    """(id, n tokens, vector): the pieces of a text as sorted 32-bit hashes with their counts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = tokens.Sizes(bc.value)
        pieces = Pieces(sizes)
        size, hashes = np.empty(0, np.int64), np.empty(0, np.uint32)
        for b in batches:
            n, vec = [], []
            if len(pieces) > 500_000:
                pieces = Pieces(sizes)
                size, hashes = np.empty(0, np.int64), np.empty(0, np.uint32)
            get = pieces.__getitem__
            for t in b.column(1).to_pylist():
                ps = tokens.split(t) if t else []
                k = np.sort(np.fromiter(map(get, ps), np.int32, len(ps)))
                if len(size) < len(pieces):
                    size = np.append(size, np.array(pieces.size[len(size) :], np.int64))
                    hashes = np.append(hashes, np.array(pieces.hash[len(hashes) :], np.uint32))
                n.append(int(size[k].sum()))
                at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
                tf = np.diff(np.append(at, len(k))).astype(np.uint32)
                vec.append(hashes[k[at]].tobytes() + tf.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(vec, pa.binary())], names=["id", "n", "vec"])

    return run


class Index:
    """BM25 over the documents of a shard, by term."""

    def __init__(self, vectors: list[bytes], k1: float = 1.2, b: float = 0.75) -> None:
        m = len(vectors)
        terms, tf, sizes = [], [], np.zeros(m, np.int64)
        for i, v in enumerate(vectors):
            n = len(v) // 8
            sizes[i] = n
            terms.append(np.frombuffer(v, np.uint32, n))
            tf.append(np.frombuffer(v, np.uint32, n, 4 * n))
        doc = np.repeat(np.arange(m), sizes)
        term = np.concatenate(terms) if terms else np.empty(0, np.uint32)
        count = np.concatenate(tf).astype(np.float32) if tf else np.empty(0, np.float32)
        length = np.bincount(doc, count, m)
        mean = max(1.0, length.mean()) if m else 1.0
        o = np.argsort(term, kind="stable")
        term, doc_by, count = term[o], doc[o], count[o]
        at = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, np.int64)
        df = np.diff(np.append(at, len(term)))
        idf = np.log1p((m - df + 0.5) / (df + 0.5)).astype(np.float32)
        weight = np.repeat(idf, df) * count * (k1 + 1) / (count + k1 * (1 - b + b * length[doc_by] / mean)).astype(np.float32)
        self.m, self.doc, self.weight = m, doc_by, weight.astype(np.float32)
        self.lo, self.hi = at, at + df
        number = np.repeat(np.arange(len(at)), df)
        self.terms, self.start = number[np.argsort(doc_by, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(doc_by, minlength=m))])

    def scores(self, i: int) -> np.ndarray:
        """Scores of all documents for document i as a query, by all its terms."""
        t = self.terms[self.start[i] : self.start[i + 1]]
        if not len(t):
            return np.zeros(self.m, np.float32)
        spans = [slice(a, b) for a, b in zip(self.lo[t], self.hi[t])]
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.m)


#: Unused space that counts as none.
LOSS = 6


class Left:
    """Unused documents by size, the largest id of a size first; a document is marked as used and passed over later."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.size, self.used = sizes, sizes <= 0
        self.count = np.bincount(sizes[sizes > 0], minlength=capacity + 1)
        self.by: dict[int, list[int]] = {}
        for i in np.flatnonzero(sizes > 0):
            self.by.setdefault(int(sizes[i]), []).append(int(i))
        self.n = int((sizes > 0).sum())
        self._last()

    def _last(self) -> None:
        """last[r]: the largest size up to r that is left, 0 for none."""
        self.last = np.maximum.accumulate(np.where(self.count > 0, np.arange(len(self.count)), 0))

    def take(self, i: int) -> int:
        size = int(self.size[i])
        self.used[i] = True
        self.count[size] -= 1
        self.n -= 1
        if not self.count[size]:
            self._last()
        return size

    def largest(self, room: int) -> int | None:
        size = int(self.last[room])
        if not size:
            return None
        of = self.by[size]
        while self.used[of[-1]]:
            of.pop()
        return of[-1]

    def smallest(self) -> int:
        return int(np.argmax(self.count > 0)) if self.n else 0

    def closes(self, size: np.ndarray, room: int) -> np.ndarray:
        """Whether, after an item of each size is taken, the room left is small or can hold another item closely enough."""
        rest = room - size
        fit = self.last[rest]
        fit = np.where((fit == size) & (self.count[size] < 2), self.last[size - 1], fit)
        return (rest <= LOSS) | (self.n < 2) | ((fit > 0) & ((rest - fit <= 2 * LOSS) | (2 * self.smallest() <= rest)))


def pack_shard(n: np.ndarray, index: Index | None, capacity: int) -> tuple[list[tuple[int, int, int, int, bool]], list[int]]:
    """([(document, piece, container, tokens, whether it is a retrieved neighbour of the container's seed)], fill of each container) for documents of n tokens each."""
    n = np.asarray(n, np.int64)
    rows: list[tuple[int, int, int, int, bool]] = []
    fill: list[int] = []
    pieces = np.where(n > capacity, n // capacity, 0)
    for i in np.flatnonzero(pieces):
        for k in range(int(pieces[i])):
            rows.append((int(i), k, len(fill), capacity, False))
            fill.append(capacity)
    left = Left(n - pieces * capacity, capacity)

    def put(i: int, near: bool) -> int:
        size = left.take(i)
        rows.append((i, int(pieces[i]), len(fill), size, near))
        return size

    while left.n:
        seed = left.largest(capacity)
        room = capacity - put(seed, False)
        if index is not None and left.last[room]:
            s = index.scores(seed)
            near = np.flatnonzero((s > 0) & ~left.used & (left.size <= room))
            near = near[np.argsort(-s[near], kind="stable")]
            while len(near):
                at = np.flatnonzero(left.closes(left.size[near], room))
                if not len(at):
                    break
                room -= put(int(near[at[0]]), True)
                near = near[at[0] + 1 :]  # those passed over would leave room that nothing fills
                near = near[left.size[near] <= room]
        while left.last[room]:
            room -= put(left.largest(room), False)
        fill.append(capacity - room)
    return rows, fill


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        t = t.sort_by([("id", "ascending"), ("n", "ascending")])
        n = t.column("n").to_numpy()
        rows, fill = pack_shard(n, Index(t.column("vec").to_pylist()), capacity)
        placed = {r[0] for r in rows}
        rows += [(i, 0, 0, 0, False) for i in range(len(n)) if i not in placed]
        fill = np.array(fill or [0], np.int64)
        i, piece, c, size, near = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 5
        return pa.table({"id": t.column("id").take(pa.array(i)), "piece": piece, "container": c + (shard << 24), "n_tokens": size, "near": near > 0, "filled": fill[c]})

    return run


def _merge(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("container", "ascending")])
        size = t.column("filled").to_numpy()
        rows, _ = pack_shard(np.maximum(size, 1), None, capacity)
        first: dict[int, int] = {}
        names = t.column("container").to_numpy()
        new = names.copy()
        for i, _, c, _, _ in rows:
            new[i] = names[first.setdefault(c, i)]
        return pa.table({"container": names, "into": new})

    return run


def pack(df: DataFrame, key: str, text: str, capacity: int = 2048, docs_per_shard: int = 2048, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(key, piece, container, n_tokens, near): where every document lies, and whether it was retrieved as a neighbour of the container's seed; one row for each container that a document above the capacity fills, and one for all others."""
    spark = df.sparkSession
    d = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = dict(d.dtypes)["id"]
    v = cut(d.mapInArrow(_vectors(tokens.shared_ranks(spark, vocabulary)), f"id {kind}, n long, vec binary"), "vectors")
    shards = max(1, -(-v.count() // docs_per_shard))
    by = v.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    out = f"id {kind}, piece long, container long, n_tokens long, near boolean, filled long"
    packed = cut(by.groupBy("shard").applyInArrow(_pack(capacity), out), "packed")
    loose = packed.where(f"filled <= {capacity // 2}").select("container", "filled").distinct()
    into = loose.groupBy(F.shiftright("container", 24 + 11).alias("g")).applyInArrow(_merge(capacity), "container long, into long")
    j = packed.join(into, "container", "left").select("id", "piece", F.coalesce("into", "container").alias("container"), "n_tokens", "near")
    return j.withColumnRenamed("id", key)
