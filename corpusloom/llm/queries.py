"""Registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import leakage, lookalike, main_content, mojibake, near_dup, packing, personal, scan_repair, sentences, site_lines
from corpusloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark, sf_dir):
    return site_lines.frequent_line_places(table(spark, sf_dir, "pretrain"), ids_unique=True).select("record_id", "line_no")


@query
def p1_clean(spark, sf_dir):
    clean = site_lines.strip_frequent_lines(table(spark, sf_dir, "pretrain"), ids_unique=True)
    return clean.select("record_id", "text")


_P1 = r"""
WITH r AS (
  SELECT record_id, text, regexp_replace(regexp_extract(lower(trim(source_url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '') AS site,
         string_split(regexp_replace(text, '[\t\r \x{a0}\x{3000}]+', ' ', 'g'), chr(10)) AS ls
  FROM pretrain),
l AS (
  SELECT record_id, site, unnest(range(len(ls))) AS line_no, trim(unnest(ls), ' ') AS line FROM r WHERE site <> '' AND text IS NOT NULL),
f AS (SELECT site, line FROM l WHERE length(line) >= 8 GROUP BY site, line HAVING count(DISTINCT record_id) >= 10),
p AS (SELECT l.record_id, l.line_no FROM l JOIN f ON l.site = f.site AND l.line = f.line)
"""
ORACLE_SQL["p1_found"] = _P1 + "SELECT record_id, CAST(line_no AS BIGINT) AS line_no FROM p"
ORACLE_SQL["p1_clean"] = _P1 + """, d AS (SELECT record_id, list(line_no) AS drops FROM p GROUP BY record_id)
SELECT t.record_id, CASE WHEN drops IS NULL THEN text ELSE
  array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(drops, i - 1)), chr(10)) END AS text
FROM pretrain t LEFT JOIN d ON t.record_id = d.record_id"""


@query
def p9_found(spark, sf_dir):
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


@query
def p9_items(spark, sf_dir):
    """Which test items leaked, in how many documents and how long at most."""
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return leaks.groupBy("item_id").agg(F.count("*").alias("docs"), F.max("run").alias("longest"))


@query
def p3_found(spark, sf_dir):
    return lookalike.lookalike_pairs(table(spark, sf_dir, "pretrain"))


@query
def p3_classes(spark, sf_dir):
    return lookalike.lookalike_classes(table(spark, sf_dir, "pretrain"))


@query
def p3_clean(spark, sf_dir):
    return lookalike.consistent_text(table(spark, sf_dir, "pretrain").select("record_id", "text"))


@query
def p5_found(spark, sf_dir):
    return mojibake.garbled_fields(table(spark, sf_dir, "pretrain"))


@query
def p5_restored(spark, sf_dir):
    return mojibake.restore(table(spark, sf_dir, "pretrain").select("record_id", "text", "source_url"))


@query
def p10_found(spark, sf_dir):
    return sentences.split_sentences(table(spark, sf_dir, "documents"))


@query
def p2_found(spark, sf_dir):
    return main_content.furniture_lines(table(spark, sf_dir, "pretrain"))


@query
def p2_clean(spark, sf_dir):
    return main_content.main_text(table(spark, sf_dir, "pretrain")).select("record_id", "text")


@query
def p7_found(spark, sf_dir):
    return personal.find_personal(table(spark, sf_dir, "pretrain"))


@query
def p7_masked(spark, sf_dir):
    return personal.mask_personal(table(spark, sf_dir, "pretrain").select("record_id", "text"))


@query
def p8_pack(spark, sf_dir):
    return packing.pack_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_spec"))


@query
def p8_fill(spark, sf_dir):
    """Per plan: containers, tokens, capacity used up and the share of it that holds tokens."""
    rows = packing.pack_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_spec")).filter("container_id is not null")
    boxes = rows.groupBy("plan", "container_id").agg(F.max("capacity_tokens").alias("cap"), F.sum("tokens").alias("tokens"))
    out = boxes.groupBy("plan").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("cap").alias("capacity"))
    return out.withColumn("fill", F.col("tokens") / F.col("capacity"))


@query
def p6_found(spark, sf_dir):
    return near_dup.near_pairs(table(spark, sf_dir, "pretrain"), measure="union")


@query
def p6_classes(spark, sf_dir):
    return near_dup.near_classes(table(spark, sf_dir, "pretrain"), measure="union")


@query
def p4_found(spark, sf_dir):
    return scan_repair.scan_faults(table(spark, sf_dir, "pretrain"))


@query
def p4_repaired(spark, sf_dir):
    return scan_repair.repair(table(spark, sf_dir, "pretrain")).select("record_id", "text")


def _p9_reduced(table_name: str, key: str) -> str:
    """Reduced texts in overlapping chunks, so that cutting 60-character pieces out of a long text stays cheap."""
    wide, plain = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
    return (
        f"SELECT {key}, substr(r, c, 559) AS r FROM (SELECT {key}, r, unnest(range(1, greatest(2, length(r)), 500)) AS c FROM "
        rf"(SELECT {key}, regexp_replace(lower(translate(text, '{wide}', '{plain}')), '[^\p{{L}}\p{{N}}]', '', 'g') AS r FROM {table_name} WHERE text IS NOT NULL))"
    )


_P9_GRAMS = "SELECT DISTINCT {k}, hash(substr(r, i, 60)) AS h, substr(r, i, 60) AS g FROM (SELECT {k}, r, unnest(range(1, length(r) - 58)) AS i FROM ({src}) WHERE length(r) >= 60)"
ORACLE_SQL["p9_found"] = (
    f"WITH ig AS MATERIALIZED ({_P9_GRAMS.format(k='item_id', src=_p9_reduced('eval_item', 'item_id'))}), dg AS ({_P9_GRAMS.format(k='doc_id', src=_p9_reduced('documents', 'doc_id')).replace('DISTINCT ', '')}) "
    "SELECT DISTINCT dg.doc_id, ig.item_id FROM dg JOIN ig ON dg.h = ig.h AND dg.g = ig.g"
)
