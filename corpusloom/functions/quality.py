"""Quality predicates: garbled text, boilerplate, length; as filters and as a reject funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.pytext import sql_quote, sql_strip, strip

GARBLED = r"[\x{80}-\x{ff}]"
FRAMES = r"[\x{80}-\x{9f}\x{2500}-\x{254b}\x{2550}-\x{257f}]"
SUSPECT = r"[\x{80}-\x{ff}\x{2500}-\x{257f}]"

# Openings of legal boilerplate sentences.
BOILERPLATE = (
    "以上所述仅为本发明的较佳实施例",
    "本发明的保护范围由所附权利要求",
    "凡依本发明申请范围",
    "应当理解的是，本申请中所述实施例仅用以说明",
    "对于本领域技术人员而言，显然本发明不限于上述",
    "在不脱离本发明的精神或基本特征",
    "在不脱离本发明设计思想的前提下",
    "任何熟习相关技艺者",
    "因此，无论从哪一点来看",
    "本发明的范围由所附权利要求",
    "但均应涵盖在本发明的保护范围",
)


def is_mojibake(c: Column) -> Column:
    """At least six signs, over 30 % of them high Latin-1, or three of C1 and frames."""
    n = F.length(c)
    high = F.regexp_count(c, F.lit(GARBLED))
    # nearly all texts hold none of these signs and need no counting
    return F.when(c.rlike(SUSPECT), (n >= 6) & ((high / n > 0.30) | (F.regexp_count(c, F.lit(FRAMES)) >= 3))).otherwise(F.when(c.isNotNull(), False))


def sql_is_mojibake(e: str) -> str:
    count = lambda p: f"len(regexp_extract_all({e}, {sql_quote(p)}))"
    return f"(length({e}) >= 6 AND (CAST({count(GARBLED)} AS DOUBLE) / length({e}) > CAST(0.30 AS DOUBLE) OR {count(FRAMES)} >= 3))"


def has_boilerplate(c: Column) -> Column:
    return c.rlike("(?md)^(?:" + "|".join(BOILERPLATE) + ")")


def reject_reason(c: Column, min_length: int, patent: bool) -> Column:
    """Why a record is dropped (null: it is kept), the first reason that holds: empty, mojibake, boilerplate, short."""
    s = strip(c)
    short = F.length(s) < min_length
    if patent:
        return F.when(s == "", "empty").when(is_mojibake(s), "mojibake").when(has_boilerplate(s), "boilerplate").when(short, "short")
    return F.when(s == "", "empty").when(short, "short").when(is_mojibake(s), "mojibake")


def sql_reject_reason(e: str, min_length: int, patent: bool) -> str:
    s = sql_strip(e)
    garbled, short = f"WHEN {sql_is_mojibake(s)} THEN 'mojibake'", f"WHEN length({s}) < {min_length} THEN 'short'"
    legal = f"WHEN regexp_matches({s}, {sql_quote('(?m)^(?:' + '|'.join(BOILERPLATE) + ')')}) THEN 'boilerplate'"
    rest = f"{garbled} {legal} {short}" if patent else f"{short} {garbled}"
    return f"CASE WHEN {s} = '' THEN 'empty' {rest} END"


def filter_quality(df: DataFrame, text_col: str, min_length: int, patent: bool) -> DataFrame:
    return df.filter(reject_reason(F.col(text_col), min_length, patent).isNull())
