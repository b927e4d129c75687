"""Structured Streaming over a drop folder: the batch transforms, unchanged, on files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.urls import url_key
from corpusloom.plans.jobs import FINAL
from corpusloom.plans.pipelines import records
from corpusloom.settings import Settings


def stream_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of text files dropped into a folder."""
    return spark.readStream.format("text").option("wholetext", True).load(folder).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_records(docs: DataFrame, kind: str, out: str, checkpoint: str, settings: Settings | None = None) -> StreamingQuery:
    """Records of streamed documents as JSON lines; what has arrived is processed, then the query ends."""
    parts = records(docs, kind, settings=settings).select("text", "category")
    return parts.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_addresses(urls: DataFrame, time_col: str, within: str = "1 hour") -> DataFrame:
    """Streamed addresses once each, spellings apart no matter, with state bounded by the watermark."""
    keyed = urls.withColumn("key", url_key(F.col("url"))).withWatermark(time_col, within)
    return keyed.dropDuplicatesWithinWatermark(["key"])


def live_status(reports: DataFrame, late: str = "2 days") -> DataFrame:
    """Streamed task reports per day and task: counters so far and whether a final report has come."""
    g = reports.withWatermark("updated_at", late).groupBy(F.window("updated_at", "1 day"), "task_id")
    return g.agg(F.max("processed_files").alias("processed_files"), F.max("total_files").alias("total_files"), F.max(F.col("status").isin(*FINAL)).alias("final"))
