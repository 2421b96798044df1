"""Incremental forms of batch operators; each gives the batch operator's result over all that has come."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zrno.operators.pairs import fold_log


def events(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """An append-only log of Parquet files as a stream."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def drain(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Takes what is there, once, into Parquet files; a rerun takes only what came since."""
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def fold(stream: DataFrame, key: str, order: list[str], values: list[str], state: str, checkpoint: str) -> StreamingQuery:
    """Keeps, for each key, the values of its last event, in a table under `state`/version=N that each micro-batch replaces; replays of a batch write the same version."""

    def step(batch: DataFrame, n: int) -> None:
        now = fold_log(batch, key, order, [*order, *values]).drop("first_seen")
        if n:
            old = batch.sparkSession.read.parquet(f"{state}/version={n - 1}")
            now = fold_log(old.unionByName(now), key, order, [*order, *values]).drop("first_seen")
        now.write.mode("overwrite").parquet(f"{state}/version={n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, state: str) -> DataFrame:
    """The last version of a fold."""
    d = spark.read.parquet(state)
    last = d.agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{state}/version={last}")


def first_copies(stream: DataFrame, content: str, time: str, delay: str) -> DataFrame:
    """Events whose content has not come before within the watermark's delay: bounded state, exact within it."""
    return stream.withColumn("_h", F.xxhash64(content)).withColumn("_s", F.sha2(content, 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["_h", "_s"]).drop("_h", "_s")


def windowed_counts(stream: DataFrame, time: str, delay: str, width: str, *by: str) -> DataFrame:
    """Events by window of time, late ones within the delay included."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


