"""Engine settings: defaults, overridable by environment or Spark configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    min_length: int = 120
    max_length: int = 2000
    patent_category: str = "专利文献"
    regulation_category: str = "法规文本"
    ocr_dpi: int = 150
    max_upload_bytes: int = 500 << 20
    max_url_bytes: int = 100 << 20
    read_timeout_s: float = 60.0
    connect_timeout_s: float = 10.0
    retries: int = 3
    max_redirects: int = 5
    max_downloads: int = 8
    html_mode: str = "extract"
    output_dir: str = "outputs"
    upload_dir: str = "uploads"
    user_agent: str = "corpusloom/1"

    @classmethod
    def load(cls, spark: SparkSession | None = None, **over) -> Settings:
        """Defaults, then ``CORPUSLOOM_<NAME>`` variables, then ``corpusloom.<name>`` of the session, then keywords."""
        got = {}
        for f in fields(cls):
            kind = type(f.default)
            raw = os.environ.get(f"CORPUSLOOM_{f.name.upper()}")
            if spark is not None:
                raw = spark.conf.get(f"corpusloom.{f.name}", raw)
            if raw is not None:
                got[f.name] = kind(raw)
        return cls(**{**got, **over})
