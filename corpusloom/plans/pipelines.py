"""Documents to records: clean, segment, project, filter. One narrow stage; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.pytext import bind
from corpusloom.functions.quality import reject_reason
from corpusloom.operators import patent, regulation, segment
from corpusloom.settings import Settings


def segments(df: DataFrame, kind: str, text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row per segment: the other columns, ``seg_no``, ``segment``; ``kind`` is patent or regulation."""
    s = settings or Settings()
    clean, cut = (regulation.clean, segment.segment_regulation) if kind == "regulation" else (patent.clean, segment.segment_patent)
    # bound once: the optimiser would otherwise inline the cleaning at every place the segmentation looks at its text
    pieces = df.withColumn("__segments", bind(clean(F.col(text_col)), lambda c: cut(c, s.min_length, s.max_length)))
    # the outer form, as the optimiser derives a filter from the inner one that evaluates the whole array twice more
    out = pieces.select(*[F.col(c) for c in df.columns if c != text_col], F.posexplode_outer("__segments").alias("seg_no", "segment"))
    return out.filter(F.col("segment").isNotNull())


def records(df: DataFrame, kind: str, text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """Kept records: the other columns, ``seg_no``, ``text``, ``category``."""
    s = settings or Settings()
    parts = segments(df, kind, text_col, s)
    kept = parts.filter(reject_reason(F.col("segment"), s.min_length, kind != "regulation").isNull())
    category = s.regulation_category if kind == "regulation" else s.patent_category
    return kept.withColumnRenamed("segment", text_col).withColumn("category", F.lit(category))


def route(df: DataFrame, type_col: str = "doc_type", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """Records of mixed documents: regulations by their own rules, everything else as patents."""
    is_regulation = F.coalesce(F.col(type_col) == "regulation", F.lit(False))
    return records(df.filter(is_regulation), "regulation", text_col, settings).unionByName(records(df.filter(~is_regulation), "patent", text_col, settings))


def reject_funnel(df: DataFrame, kind: str, text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """How many segments are kept and dropped, by reason."""
    s = settings or Settings()
    parts = segments(df, kind, text_col, s)
    return parts.select(F.coalesce(reject_reason(F.col("segment"), s.min_length, kind != "regulation"), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("segments"))


def preview(records: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The first records in document order."""
    return records.orderBy(key, "seg_no").limit(n)
