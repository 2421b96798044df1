"""Connected components and ranking without any unbounded group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zrno.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node id it reaches.

    Alternates large-star and small-star steps: each round is two aggregations and two joins over the edge list, and the
    number of rounds is logarithmic in the diameter. Null ends and self-loops tie nothing, though a self-loop's node is
    kept. An empty list gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct()
    e = cut(e, "edges")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e, mark = e.where("u <> v"), None
    for _ in range(max_rounds):
        e = cut(_small_star(_large_star(e)), "stars")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def ranked(df: DataFrame, group: list[str], order: Column, name: str = "rn", buckets: int = 4096) -> DataFrame:
    """Adds a gapless 1-based rank within each group, in the order of a 64-bit hash.

    A group is cut into ranges of the hash; ranges are counted, the counts (groups x buckets rows) are summed up, and rows
    are numbered within a range. No task holds more than one range of a group.
    """
    step = (1 << 64) // buckets
    at, cut_, n, before, rn = (f"__ranked_{x}" for x in ("hash", "range", "count", "before", "rank"))
    d = df.withColumn(at, order).withColumn(cut_, F.floor(F.col(at) / F.lit(step)).cast("int"))
    counts = d.groupBy(*group, cut_).agg(F.count(F.lit(1)).alias(n))
    sums = counts.withColumn(before, F.coalesce(F.sum(n).over(Window.partitionBy(*group).orderBy(cut_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*group, cut_).orderBy(at, *[c for c in df.columns if c not in group]))
    cond = F.lit(True)
    for k in [*group, cut_]:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return d.withColumn(rn, rank).alias("l").join(sums.alias("r"), cond).select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{rn}") + F.col(f"r.{before}")).alias(name))


def numbered(df: DataFrame, order: list[str], size: str | None = None, name: str = "rn", before: str = "before") -> DataFrame:
    """Adds a 1-based rank over all rows in the order of columns that tell every row apart, and, for `size`, the sum of it over the rows before.

    Rows are range-partitioned; what precedes a partition comes from one row for each partition, so no task sees more than its range.
    """
    part, n, s, lo, off, sofar, r, within = (f"__numbered_{x}" for x in ("part", "n", "s", "lo", "off", "sofar", "r", "within"))
    d = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ordered")
    zero = F.lit(0).cast("long")
    each = d.groupBy(part).agg(F.count(F.lit(1)).alias(n), (F.sum(size) if size else zero).alias(s), F.min(F.struct(*order)).alias(lo))
    earlier = Window.orderBy(lo).rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(part, F.coalesce(F.sum(n).over(earlier), zero).alias(off), F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(sofar))
    w = Window.partitionBy(part).orderBy(*order)
    d = d.withColumn(r, F.row_number().over(w))
    if size:
        d = d.withColumn(within, F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cols = [F.col(c) for c in df.columns] + [(F.col(r) + F.col(off)).alias(name)] + ([(F.col(within) + F.col(sofar)).alias(before)] if size else [])
    return d.join(each, part).select(*cols)
