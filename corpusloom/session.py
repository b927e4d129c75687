"""Session helpers shared by every operator: table access, lineage cuts, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while its measured size stays below this many bytes.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in ``spark.corpusloom.spread`` parts where the session sets that number: files of one row group are read by one
    task, and costly narrow work on them would run in that task alone. Unset, nothing moves."""
    n = int(df.sparkSession.conf.get("spark.corpusloom.spread", "0"))
    return df.repartition(n) if n else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: ``spark.checkpoint.dir`` where the cluster names one, else a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Lets Spark delete the shuffle files of an execution as soon as it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder; later reads survive the loss of any executor.

    The shuffle files that led there are of no further use, so Spark is told to delete them with the execution; otherwise
    they would stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting is read where an execution's plan is made
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def bounded(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` (already materialised by :func:`cut`) is small enough to broadcast."""
    return df.count() * row_bytes <= limit


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted size is under the limit, unchanged otherwise."""
    return F.broadcast(df) if bounded(df, row_bytes, limit) else df


def hash_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those of the least key hash; only about twice as many leave the scan, whatever its size."""
    n = df.count()
    h = F.xxhash64(F.col(key), F.lit(42))
    if n > 4 * limit:
        df = df.filter(F.shiftrightunsigned(h, 33) < int(2 * limit / n * (1 << 31)) + 1)
    return df.orderBy(h, F.col(key)).limit(limit)


def build(app: str = "corpusloom", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
