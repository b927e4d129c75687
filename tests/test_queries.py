"""Every registered query that has SQL agrees with DuckDB on the smallest tables; the others run."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DIR}/{f}')")
    return con


@pytest.mark.parametrize("name", [n for n in entry.core.QUERIES])
def test_query(spark, duck, name):
    df = entry.core.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = Counter(repr(tuple(r[c] for c in cols)) for r in df.collect())
    if name in entry.core.ORACLE_SQL:
        got = duck.execute(entry.core.ORACLE_SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == Counter(repr(tuple(x[i] for i in at)) for x in got.fetchall())


STAGES = [n for n in entry.core.QUERIES if entry.core.QUERIES[n].__closure__ and n.startswith(("patent_", "regulation_")) and "AS text FROM (SELECT record_id, replace(" in entry.core.ORACLE_SQL[n]]


@pytest.mark.parametrize("name", STAGES)
def test_stage_changes_texts(duck, name):
    """Every cleaning query meets what its stage is made for."""
    kind = name.split("_")[0]
    plain = f"SELECT record_id, text AS before FROM ({entry.core.sql_decorated('pretrain', 'record_id', kind)})"
    (n,) = duck.execute(f"SELECT count(*) FROM ({entry.core.ORACLE_SQL[name]}) JOIN ({plain}) USING (record_id) WHERE text <> before").fetchone()
    assert n == 300


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_streaming(spark, tmp_path):
    from corpusloom.streaming import drop_folder

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("一、" + "应当保存检测记录不少于十二个月。" * 10)
    q = drop_folder.write_records(drop_folder.stream_documents(spark, str(tmp_path / "in")), "regulation", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 1
