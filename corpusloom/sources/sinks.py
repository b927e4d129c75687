"""JSON-lines output."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(records: DataFrame, path: str, single: bool = False, mode: str = "overwrite") -> None:
    """One JSON object (text, category) a line, UTF-8; ``single`` gathers small results in one file, large ones keep a file a task."""
    out = records.select("text", "category")
    (out.coalesce(1) if single else out).write.mode(mode).option("ignoreNullFields", False).json(path)


def output_name(stem: Column, regulation: Column, at: Column) -> Column:
    return F.concat(F.when(regulation, "reg_").otherwise(""), stem, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".jsonl"))


def batch_name(at: Column, digest: Column) -> Column:
    """Name of the merged result of an address batch."""
    return F.concat(F.lit("url_batch_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(digest, 1, 8), F.lit(".jsonl"))


def archive_name(stem: Column, regulation: Column, at: Column) -> Column:
    """Name of the merged result of an archive."""
    return F.concat(F.when(regulation, "reg_").otherwise("batch_"), stem, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".jsonl"))


def resolve_output(base: str, name: str) -> Path:
    """Path of a result inside the output folder; PermissionError outside it, FileNotFoundError if there is none."""
    root = Path(base).resolve()
    p = (root / name).resolve()
    if not p.is_relative_to(root):
        raise PermissionError(name)
    if not p.exists():
        raise FileNotFoundError(name)
    return p
