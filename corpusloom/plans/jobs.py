"""Roll-ups of job reports and per-address results; the worker plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINAL = ("completed", "failed")


def job_status(reports: DataFrame) -> DataFrame:
    """One row a task from its reports, sent twice, late or out of order: counters are maxima, text fields come from the
    latest report, and a final status holds against later-arriving progress."""
    latest = F.struct("updated_at", "received_at", "status", "processed_files", F.coalesce("current_file", F.lit("")).alias("f"), F.coalesce("error", F.lit("")).alias("e"), F.coalesce("output_filename", F.lit("")).alias("o"))
    final = F.when(F.col("status").isin(*FINAL), F.struct("updated_at", "received_at", "status"))
    g = reports.groupBy("task_id").agg(
        F.max(latest).alias("l"), F.max(final).alias("x"), F.max("total_files").alias("total_files"), F.max("processed_files").alias("processed_files"),
        F.max("record_count").alias("record_count"), F.max("output_filename").alias("output_filename"), F.max("error").alias("error"),
    )
    progress = F.when(F.col("total_files") > 0, F.round(F.col("processed_files") / F.col("total_files") * 100).cast("int"))
    return g.select("task_id", F.coalesce("x.status", "l.status").alias("status"), "total_files", "processed_files", progress.alias("progress"), "record_count", "output_filename", "error")


def lookup(status: DataFrame, task_id: str) -> DataFrame:
    return status.filter(F.col("task_id") == task_id)


def url_results(submissions: DataFrame, downloads: DataFrame, counts: DataFrame, errors: Column) -> DataFrame:
    """Per-address results of a batch: refused addresses are skipped, failed downloads failed, others carry their record count."""
    checked = submissions.withColumn("refused", errors)
    skipped = checked.filter("refused <> ''").select("task_id", "url", F.lit("skipped").alias("status"), F.lit(None).cast("bigint").alias("record_count"), F.col("refused").alias("error"))
    asked = checked.filter("refused = ''").select("task_id", "url")
    got = asked.join(downloads, ["task_id", "url"]).join(counts, "url", "left")
    rest = got.select("task_id", "url", "status", F.when(F.col("status") == "success", F.coalesce("n", F.lit(0)).cast("bigint")).alias("record_count"), F.col("error"))
    return skipped.unionByName(rest)


def parallel_plan(cpus: Column, ram_gb: Column, gpus: Column | None = None, vram_mb: Column | None = None) -> Column:
    """(workers, batch, serial) for given resources."""
    w = F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), cpus - 2), F.greatest(F.lit(1), F.floor(ram_gb / F.lit(1.8)).cast("int"))))
    serial = (w <= 1) | (cpus <= 2) | (ram_gb < 4)
    cpu = F.struct(F.when(serial, 1).otherwise(F.least(w, F.lit(8))).cast("int").alias("workers"), F.lit(1).alias("batch"), serial.alias("serial"))
    if gpus is None:
        return cpu
    batch = F.least(F.greatest(F.lit(4), F.floor(F.greatest(vram_mb, F.lit(4096)) / 2048)), F.lit(16)).cast("int")
    gpu = F.struct(F.least(gpus, F.lit(2)).cast("int").alias("workers"), batch.alias("batch"), F.lit(False).alias("serial"))
    return F.when(gpus > 0, gpu).otherwise(cpu)
