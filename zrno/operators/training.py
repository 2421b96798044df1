"""The data side of training: token streams, batches, chat examples with masks, replay shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


IGNORE = -1
BUCKETS = 1 << 16


def placed(docs: DataFrame, key: str, size: str, seed: int = 1, epoch: int = 0, order: Column | None = None) -> DataFrame:
    """Adds pos, each document's first token in a permutation of all documents by seed and epoch, or in the order of a 64-bit hash.

    Documents are ordered by a hash, which is cut into 65,536 ranges; the ranges' totals are summed up in order, and positions within a
    range by a window, so no task holds more than a range.
    """
    h = F.xxhash64(key, F.lit(seed), F.lit(epoch)) if order is None else order
    d = docs.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 48))
    total = d.groupBy("_b").agg(F.sum(size).alias("_n"))
    before = total.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_before")
    within = F.coalesce(F.sum(size).over(Window.partitionBy("_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_w", within).join(before, "_b").withColumn("pos", (F.col("_w") + F.col("_before")).cast("long")).drop("_h", "_b", "_w", "_before")


def batch_rows(stream: DataFrame, tokens: str, seq_len: int, batch_size: int, total: int | None = None) -> DataFrame:
    """(batch, row, x, y): the stream of placed documents cut into windows of seq_len targets; what doesn't fill a batch is left out. total: the number of all tokens, if it is known."""
    n = stream.agg(F.coalesce(F.sum(F.size(tokens)), F.lit(0))).first()[0] if total is None else total
    rows = max(0, (n - 1) // seq_len // batch_size * batch_size)
    size, at = F.size(tokens), lambda w: w * seq_len - F.col("pos")
    # a window's last target is the first token of the next one, so a document reaches from the window its first token is a target of
    lo, hi = F.greatest(F.floor((F.col("pos") - 1) / seq_len), F.lit(0)).cast("long"), F.floor((F.col("pos") + size - 1) / seq_len).cast("long")
    piece = lambda w: F.slice(tokens, F.greatest(at(w), F.lit(0)).cast("int") + 1, (F.least(at(w) + seq_len + 1, size) - F.greatest(at(w), F.lit(0))).cast("int"))
    d = stream.where(size > 0).select("pos", tokens, lo.alias("_lo"), F.least(hi, F.lit(rows - 1)).alias("_hi")).where("_lo <= _hi")
    each = d.select(F.explode(F.transform(F.sequence("_lo", "_hi"), lambda w: F.struct(w.alias("w"), F.col("pos").alias("p"), piece(w).alias("tok")))).alias("x")).select("x.*")
    g = each.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("p", "tok"))).alias("a"))
    ids = F.flatten(F.transform("a", lambda x: x.tok))
    return g.select(F.floor(F.col("w") / batch_size).cast("long").alias("batch"), (F.col("w") % batch_size).cast("int").alias("row"), F.slice(ids, 1, seq_len).alias("x"), F.slice(ids, 2, seq_len).alias("y"))


def steps_per_epoch(n_tokens: Column, seq_len: int, batch_size: int) -> Column:
    return F.floor(F.floor((n_tokens - 1) / seq_len) / batch_size)


def chat_examples(pairs: DataFrame, key: str, prompt: str, target: str, special: dict[str, int], seq_len: int) -> DataFrame:
    """(key, tokens, n_prompt, n_target, y, fits): prompt and answer between their marks; targets are the answer and its closing mark, the rest is ignored. Examples above seq_len + 1 do not fit."""
    one = lambda k: F.array(F.lit(special[k]))
    p = F.concat(one("bos"), one("user_start"), F.col(prompt), one("user_end"), one("assistant_start"))
    t = F.concat(F.col(target), one("assistant_end"))
    d = pairs.select(key, p.alias("p"), t.alias("t"))
    return d.select(key, F.concat("p", "t").alias("tokens"), F.size("p").alias("n_prompt"), F.size("t").alias("n_target"), F.concat(F.array_repeat(F.lit(IGNORE), F.size("p") - 1), "t").alias("y"), (F.size("p") + F.size("t") <= seq_len + 1).alias("fits"))


def length_batches(examples: DataFrame, key: str, size: str, batch_size: int, seed: int = 1, order: Column | None = None) -> DataFrame:
    """(key, batch): examples ordered by length, equal lengths by a seeded 64-bit hash or the one given, in groups of batch_size. Lengths are counted first; ranks are a length's offset and a rank within it."""
    from zrno.operators.components import ranked

    d = examples.select(key, F.col(size).alias("_n"), (F.xxhash64(key, F.lit(seed)) if order is None else order).alias("_o"))
    n = d.groupBy("_n").agg(F.count(F.lit(1)).alias("_k"))
    off = n.withColumn("_off", F.coalesce(F.sum("_k").over(Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_n", "_off")
    r = ranked(d, ["_n"], F.col("_o"), "_r").join(off, "_n")
    return r.select(key, F.floor((F.col("_off") + F.col("_r") - 1) / batch_size).cast("long").alias("batch"))


def collate(examples: DataFrame, batch: str, pad: int = 0) -> DataFrame:
    """Pads x and y of each example to its batch's longest."""
    w = examples.groupBy(batch).agg((F.max(F.size("tokens")) - 1).alias("width"))
    d = examples.join(w, batch)
    x = F.slice("tokens", F.lit(1), F.size("tokens") - 1)
    fill = lambda a, v: F.concat(a, F.array_repeat(F.lit(v), F.col("width") - F.size(a)))
    return d.withColumns({"x": fill(x, pad), "y": fill(F.col("y"), IGNORE)}).drop("width")


def replay_windows(target_tokens: Column, seq_len: int, share: float) -> Column:
    """How many windows make `share` of the scored tokens; rounded half to even, one at least where there is a share."""
    return F.lit(0) if share == 0 else F.greatest(F.lit(1), F.bround(target_tokens * (share / (1 - share)) / seq_len, 0).cast("long"))


def draw_windows(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n of the rows of x and y (each a whole window) as examples (key, tokens, y, n_prompt, n_target, replay), those with the smallest seeded hash of their place; fewer are an error. Every position is scored, so n_prompt is 1."""
    from zrno.session import cut

    h = F.xxhash64("batch", "row", F.lit(seed))
    some = cut(rows.select("batch", "row", h.alias("h")).orderBy("h", "batch", "row").limit(n), "drawn")
    have = some.count()
    if have < n:
        raise ValueError(f"{n} replay windows are needed, the corpus holds {have}")
    d = rows.join(F.broadcast(some), ["batch", "row"])  # as many as were asked for
    return d.select(F.concat(F.lit("replay:"), "batch", F.lit(":"), "row").alias("key"), F.concat("x", F.slice("y", -1, 1)).alias("tokens"), F.col("y"), F.lit(1).alias("n_prompt"), F.size("y").alias("n_target"), F.lit(True).alias("replay"))


def with_replay(examples: DataFrame, key: str, windows: DataFrame) -> DataFrame:
    """Examples (key, tokens, y, n_prompt, n_target) and drawn windows as one set; the examples alone stay what held-out loss is measured on."""
    e = examples.select(F.col(key).cast("string").alias("key"), "tokens", "y", "n_prompt", "n_target", F.lit(False).alias("replay"))
    return e.unionByName(windows)


def replay_shares(examples: DataFrame, batch: str, n_target: str, replay: str) -> DataFrame:
    """(token_share, step_share): of the scored tokens, and of the batches that hold a replay window."""
    b = examples.groupBy(batch).agg(F.max(F.col(replay).cast("int")).alias("any"), F.sum(n_target).alias("n"), F.sum(F.when(F.col(replay), F.col(n_target)).otherwise(0)).alias("r"))
    return b.agg((F.sum("r") / F.sum("n")).alias("token_share"), F.avg("any").alias("step_share"))


def learning_rate(step: Column, warmup: int, total: int, peak: float, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine to `floor` of the peak."""
    at = F.least(F.greatest((step - warmup) / max(1, total - warmup), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(at * 3.141592653589793))))


