"""Lines repeated across one site's documents.

A line is compared in its normal form: each run of blanks is one space, none at either end. The site is the host of the
record's address, in lower case, without port and leading ``www.``. A line is frequent on a site when its normal form
has at least ``min_chars`` characters and stands in at least ``min_docs`` different records of that site (or in at least
``min_share`` of them, where that is more).

Plan: one narrow pass hashes the normal lines of each record (distinct within the record); a partially aggregated count
per (site, line) hash is the only shuffle, and a hot line shrinks to one row per map task before it. The frequent set
comes back as a broadcast while its counted size is bounded; beyond that the most frequent ``HOT_ROWS`` lines are
broadcast and only the rest, none of which is hot, goes through a shuffled join.

Defined cases: null text or null / empty address gives no line and leaves the record as it is; an empty table gives no
rows; a line that stands twice in one record counts once and both places are reported; repeated rows (the same id again)
count once unless ``ids_unique`` is set; other columns of the input are carried through ``strip_frequent_lines``
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import bounded, cut

BLANKS = "[\\t\\r \\u00a0\\u3000]+"
#: Rows of the frequent set that are broadcast when the whole set is too large; bounded whatever the input.
HOT_ROWS = 500_000
ROW_BYTES = 48


def site_of(url: Column) -> Column:
    """Host of an address in lower case without port and leading ``www.``; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def normal_lines(text: Column) -> Column:
    """Array of the text's lines in normal form."""
    return F.transform(F.split(F.regexp_replace(text, BLANKS, " "), "\n", -1), lambda x: F.trim(x))


def _keys(site: Column, line: Column) -> Column:
    return F.struct(F.xxhash64(site, line).alias("h1"), F.xxhash64(line, F.lit("2nd"), site).alias("h2"))


def _hashed(df: DataFrame, id_col: str, text_col: str, url_col: str, min_chars: int) -> DataFrame:
    """(rid, site, keys): keys[i] is the hash of line i, null where the line is too short to count."""
    base = df.select(F.col(id_col).alias("rid"), F.col(text_col).alias("t"), site_of(F.col(url_col)).alias("site"))
    base = base.filter("site is not null and t is not null")
    return base.select(
        "rid", "site", F.transform(normal_lines(F.col("t")), lambda x: F.when(F.length(x) >= min_chars, _keys(F.col("site"), x))).alias("keys")
    )


def frequent_line_keys(hashed: DataFrame, min_docs: int, min_share: float, ids_unique: bool) -> DataFrame:
    per = hashed.select("rid", "site", F.explode(F.array_distinct("keys")).alias("k")).filter("k is not null")
    per = per.select("rid", "site", "k.h1", "k.h2")
    n = F.count("*") if ids_unique else F.count_distinct("rid")
    if min_share > 0:
        sizes = hashed.groupBy("site").agg((F.count("*") if ids_unique else F.count_distinct("rid")).alias("site_docs"))
        freq = per.groupBy("site", "h1", "h2").agg(n.alias("docs")).filter(F.col("docs") >= min_docs)
        freq = freq.join(sizes, "site").filter(F.col("docs") >= F.col("site_docs") * min_share)
    else:
        freq = per.groupBy("h1", "h2").agg(n.alias("docs")).filter(F.col("docs") >= min_docs)
    return freq.select("h1", "h2", "docs")


def frequent_line_places(
    df: DataFrame,
    id_col: str = "record_id",
    text_col: str = "text",
    url_col: str = "source_url",
    min_docs: int = 10,
    min_chars: int = 8,
    min_share: float = 0.0,
    ids_unique: bool = False,
) -> DataFrame:
    """One row (record_id, line_no, docs) for every place of a frequent line."""
    hashed = _hashed(df, id_col, text_col, url_col, min_chars)
    freq = cut(frequent_line_keys(hashed, min_docs, min_share, ids_unique))
    places = hashed.select("rid", F.posexplode("keys").alias("line_no", "k")).filter("k is not null")
    places = places.select("rid", "line_no", "k.h1", "k.h2")
    if bounded(freq, ROW_BYTES):
        found = places.join(F.broadcast(freq), ["h1", "h2"])
    else:
        hot = cut(freq.orderBy(F.desc("docs"), "h1", "h2").limit(HOT_ROWS))
        in_hot = places.join(F.broadcast(hot), ["h1", "h2"])
        cool = places.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
        found = in_hot.unionByName(cool.join(freq, ["h1", "h2"]))
    out = found.select(F.col("rid").alias("record_id"), F.col("line_no").cast("bigint").alias("line_no"), "docs")
    return out if ids_unique else out.distinct()


def strip_frequent_lines(df: DataFrame, id_col: str = "record_id", text_col: str = "text", url_col: str = "source_url", **how) -> DataFrame:
    """``df`` with the frequent lines taken out of its text; every other column and record as it was."""
    places = frequent_line_places(df, id_col, text_col, url_col, **how)
    drop = places.groupBy(F.col("record_id").alias("__rid")).agg(F.collect_set("line_no").alias("__drop"))
    joined = df.join(drop, df[id_col] == drop["__rid"], "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.col("__drop"), i.cast("bigint")))
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).drop("__rid", "__drop")
