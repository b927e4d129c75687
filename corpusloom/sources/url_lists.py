"""URL lists in text, CSV and JSON files as DataFrames (pos, url)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.pytext import NOT_WS, strip

KEYS = ("url", "link", "href", "download_url", "pdf_url")
TRAIL = r"""[.,;:!?"'）)】\]]+$"""


def url_in_line(line: Column) -> Column:
    """First address in a line, closing punctuation dropped; a line that merely starts like one, whole; else null."""
    s = strip(line)
    found = F.regexp_replace(F.regexp_extract(s, rf"https?://{NOT_WS}+", 0), TRAIL, "")
    return F.when((s == "") | s.startswith("#"), None).when(found != "", found).when(s.startswith("http"), s)


def parse_text(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1), url_in_line), lambda x: x.isNotNull())


def parse_csv(content: Column) -> Column:
    """First cells that are addresses."""
    cell = lambda x: strip(F.when(x.startswith('"'), F.regexp_replace(F.regexp_extract(x, '^"((?:[^"]|"")*)"', 1), '""', '"')).otherwise(F.substring_index(x, ",", 1)))
    return F.filter(F.transform(F.split(content, "\r\n|\n|\r", -1), cell), lambda x: x.rlike("^https?://"))


def parse_json(content: Column) -> Column:
    """Array: strings as they are, of objects the first known key that holds an address; object: addresses among its
    values, one list deep. Anything else gives null (an error to the caller)."""
    kind = F.substring(strip(content), 1, 1)
    items = F.from_json(content, "array<string>")
    one = lambda x: F.when(
        strip(x).startswith("{"), F.coalesce(*[F.when(F.get_json_object(x, f"$.{k}").startswith("http"), F.get_json_object(x, f"$.{k}")) for k in KEYS])
    ).otherwise(x)
    values = F.map_values(F.from_json(content, "map<string,string>"))
    deep = lambda v: F.when(strip(v).startswith("["), F.filter(F.from_json(v, "array<string>"), lambda y: y.startswith("http"))).when(v.startswith("http"), F.array(v)).otherwise(F.array().cast("array<string>"))
    array = F.filter(F.transform(items, one), lambda x: x.isNotNull())
    return F.when(kind == "[", array).when(kind == "{", F.flatten(F.transform(values, deep)))


def parse_url_list(content: Column, ext: Column) -> Column:
    """Addresses of a list by the file's extension; null for an unknown extension or broken JSON."""
    e = F.regexp_replace(F.lower(ext), r"^\.", "")
    return F.when(e.isin("txt", "text"), parse_text(content)).when(e == "csv", parse_csv(content)).when(e == "json", parse_json(content))


def read_url_list(spark, path: str) -> DataFrame:
    """(pos, url) of the list files under a path; a file that is no list fails the read."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.element_at(F.split(F.input_file_name(), r"\."), -1).alias("ext"))
    known = F.lower("ext").isin("txt", "text", "csv", "json")
    ext = F.when(known, F.col("ext")).otherwise(F.raise_error(F.concat(F.lit("Unsupported file type: ."), "ext")))
    return files.withColumn("ext", ext).select(F.posexplode(parse_url_list(F.col("content"), F.col("ext"))).alias("pos", "url"))
