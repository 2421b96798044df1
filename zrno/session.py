"""Session set-up and lineage cutting."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []


def local_session(cpus: str | int = "*", app: str = "zrno", **conf: str) -> SparkSession:
    """A session for one machine (tests, bench). On a cluster the submitter's settings are used as they are."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ZRNO_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and the master is local, since on a cluster each executor would write to its own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="zrno-")
        shared_dir.own = at
        at = "file://" + at
    return at.rstrip("/")


def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
    _SCRATCH.clear()


atexit.register(_clean)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/zrno-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    _SCRATCH.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes what cut() wrote for df, which is read no more."""
    spark, files = df.sparkSession, df.inputFiles()
    for at in [x for x in _SCRATCH if x[0] is spark and any(x[1].rpartition("/")[2] in f for f in files)]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at[1])
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _SCRATCH.remove(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Shuffles by round robin only if the scan gives fewer tasks than there are cores: single-file tables would otherwise run in one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
