import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusloom.session import build


@pytest.fixture(scope="session")
def spark():
    s = build("tests", cpus="4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture
def column(spark):
    """Applies a column function to texts, keeping their order."""
    from pyspark.sql import functions as F

    def run(f, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        return [r.x for r in rows.select("i", f(F.col("text")).alias("x")).orderBy("i").collect()]

    return run
