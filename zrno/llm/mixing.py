"""Mixing sources to target weights.

The mix has as many tokens as the whole table. It is counted in blocks of equal size; Sainte-Lague apportionment gives each source
whole blocks by the highest quotients of its target share, never more than its tokens allow at the capped number of repeats. Each
source's blocks are apportioned in the same way among groups of its shards, and each group's among its shards, so that no list
of shards is longer than `group`. Within a source's shard, documents lie end to end in the order of a seeded hash and are cut into
blocks where they begin; whole rounds give every block once. As documents are whole, real blocks differ in size, so a last,
partial round takes those that fit into what is still wanted, by tokens, in a seeded order. A document is used as often as its block.

Nulls: documents without text or source, and of sources without a target, are not used; a target without documents or a null
target has no share, and what capped or empty sources cannot fill goes to the others. Repeated targets must not occur. Repeated
rows are documents of their own. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zrno.llm import tokens
from zrno.llm.grams import mix as mix64
from zrno.session import cut


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients weight / (2 k + 1), none beyond its cap.

    The number of quotients above a bound is known in closed form, so the bound is bisected and only the last few seats are
    dealt one by one, whatever their number. Ties go to the earlier weight.
    """
    w = [max(0.0, x or 0.0) for x in weights]
    caps = [max(0, c) if x > 0 else 0 for x, c in zip(w, caps)]
    seats = min(seats, sum(caps))
    if seats <= 0:
        return [0] * len(w)

    def held(q: float) -> list[int]:
        return [min(c, max(0, math.floor((x / q - 1) / 2) + 1)) if x > 0 else 0 for x, c in zip(w, caps)]

    lo, hi = min(x for x in w if x > 0) / (2 * seats + 2) / 4, max(w) * 2
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        if sum(held(mid)) > seats:
            lo = mid
        else:
            hi = mid
    got = held(hi)
    while sum(got) < seats:
        k = max((i for i in range(len(w)) if got[i] < caps[i]), key=lambda i: (w[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


def _among(limit: dict[str, int], block: int):
    """The quota of a source's group of shards apportioned among them."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("shard", "ascending")])
        have, m = t.column("t").to_pylist(), limit[t.column("source")[0].as_py()]
        got = sainte_lague([float(x) for x in have], t.column("q")[0].as_py(), [-(-x // block) * m for x in have])
        return pa.table({"source": t.column("source"), "shard": t.column("shard"), "quota": pa.array(got, pa.int64())})

    return run


def chosen(sizes: np.ndarray, want: int, seed: int) -> np.ndarray:
    """How often each block is used so that they make up `want` tokens as nearly as whole blocks can in a seeded order."""
    total = int(sizes.sum())
    if not total or want <= 0:
        return np.zeros(len(sizes), np.int64)
    out = np.full(len(sizes), want // total, np.int64)
    rest = want % total
    order = np.argsort(mix64(np.arange(len(sizes), dtype=np.uint64) + np.uint64(seed)), kind="stable")
    left = []
    for k in order:
        if sizes[k] <= rest:
            out[k] += 1
            rest -= int(sizes[k])
        else:
            left.append(k)
    if left and rest:
        k = min(left, key=lambda k: sizes[k])
        if sizes[k] < 2 * rest:  # nearer with it than without
            out[k] += 1
    return out


def _choose(limit: dict[str, int], block: int, seed: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("o", "ascending"), ("n_tokens", "ascending")])
        n = t.column("n_tokens").to_numpy()
        at = np.unique((np.cumsum(n) - n) // block, return_inverse=True)[1]
        source = t.column("source")[0].as_py()
        copies = chosen(np.bincount(at, n).astype(np.int64), int(t.column("quota")[0].as_py()) * block, seed + int(t.column("shard")[0].as_py()))
        copies = np.minimum(copies[at], limit[source])
        use = copies > 0
        return pa.table({"id": t.column("id").filter(pa.array(use)), "source": t.column("source").filter(pa.array(use)), "n_tokens": n[use], "copies": copies[use].astype(np.int32)})

    return run


def mix(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, block: int = 256, shard_tokens: int = 4_000_000, group: int = 4096, seed: int = 1, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(key, source, n_tokens, copies) of every document that the mix uses.

    targets: source, target_share, max_repeats; one row for each source, so they are collected. Shards: as many for all sources
    as the table's tokens fill; what is collected of them is a row for each source and `group` of shards.
    """
    n = cut(tokens.count_tokens(docs, key, text, vocabulary, keep=(source,)).select(F.col(key).alias("id"), F.col(source).alias("source"), "n_tokens"), "sizes")
    total = int(n.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    count = max(1, -(-total // shard_tokens))
    plan = [r for r in targets.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0").orderBy("source").collect()]
    limit = {r[0]: max(0, int(r[2] if r[2] is not None else 1)) for r in plan}
    usable = n.where("n_tokens > 0 and source is not null").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("long"))
    spark = docs.sparkSession
    names = spark.createDataFrame([(r[0],) for r in plan], "source string")
    usable = usable.join(F.broadcast(names), "source", "left_semi")  # one row for each target
    each = cut(usable.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")).withColumn("g", F.floor(F.col("shard") / group)), "shards")
    sums = each.groupBy("source", "g").agg(F.sum("t").alias("t"), F.sum(F.ceil(F.col("t") / block)).alias("b")).orderBy("source", "g").collect()
    have: dict[str, list] = {r[0]: [] for r in plan}
    for r in sums:
        have[r[0]].append(r)
    quota = sainte_lague([r[1] for r in plan], -(-total // block), [sum(x["t"] for x in have[r[0]]) * limit[r[0]] // block for r in plan])
    rows = []
    for r, q in zip(plan, quota):
        of = have[r[0]]
        rows += [(r[0], x["g"], y) for x, y in zip(of, sainte_lague([float(x["t"]) for x in of], q, [x["b"] * limit[r[0]] for x in of])) if y]
    groups = spark.createDataFrame(rows, "source string, g long, q long")
    quotas = each.join(F.broadcast(groups), ["source", "g"]).groupBy("source", "g").applyInArrow(_among(limit, block), "source string, shard long, quota long").where("quota > 0")
    d = usable.join(quotas, ["source", "shard"]).withColumn("o", F.xxhash64("id", F.lit(seed + 1)))
    kind = dict(d.dtypes)["id"]
    out = d.groupBy("source", "shard").applyInArrow(_choose(limit, block, seed), f"id {kind}, source string, n_tokens long, copies int")
    return out.withColumnRenamed("id", key)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_docs, n_tokens, most_copies) of every target, tokens counted as often as used."""
    s = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    total = s.agg(F.sum("n_tokens").alias("total"))
    t = targets.select("source", "target_share")
    j = t.join(s, "source", "left").withColumn("_1", F.lit(1)).join(F.broadcast(total.withColumn("_1", F.lit(1))), "_1")
    return j.select("source", "target_share", (F.coalesce("n_tokens", F.lit(0)) / F.col("total")).alias("actual_share"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
