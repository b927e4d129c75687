"""Documents from files: uploads with admission, archives, pages through pluggable renderer and recogniser, downloads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.pytext import strip
from corpusloom.functions.urls import derive_filename, is_html_content, is_pdf_content, url_error
from corpusloom.operators import html
from corpusloom.settings import Settings
from corpusloom.sources.http import download

#: Unpacked bytes a worker holds before it hands entries on.
OPEN_BYTES = 32 << 20
EXTENSIONS = ("pdf", "zip", "html", "htm")


def scan(spark: SparkSession, path: str, settings: Settings | None = None) -> DataFrame:
    """Files under a path as (file_name, ext, length, content, reason); only admitted files have their content read,
    since the predicate on the length reaches the source."""
    s = settings or Settings()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    reason = F.when(~ext.isin(*EXTENSIONS), "extension").when(F.col("length") == 0, "empty").when(F.col("length") > s.max_upload_bytes, "too_large")
    ok = files.filter(F.col("length").between(1, s.max_upload_bytes)).withColumn("content", F.when(reason.isNull(), F.col("content")))
    bad = files.filter(~F.col("length").between(1, s.max_upload_bytes)).withColumn("content", F.lit(None).cast("binary"))
    return ok.unionByName(bad).select(name.alias("file_name"), ext.alias("ext"), "length", "content", reason.alias("reason"))


def _name(info: zipfile.ZipInfo) -> str:
    """Entry name: UTF-8 when flagged, else GBK where that reads, else as the archive has it."""
    if info.flag_bits & 0x800:
        return info.filename
    try:
        return info.filename.encode("cp437").decode("gbk")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return info.filename


def unzip(files: DataFrame) -> DataFrame:
    """(zip_name, entry_no, entry_name, ext, content, error) of (file_name, content): PDF and HTML entries, the last one of
    a name; other entries are passed over before they are decompressed; a broken archive or entry is a row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["zip_name", "entry_no", "entry_name", "ext", "content", "error"]
        frame = lambda rows: pd.DataFrame(rows, columns=cols).astype({"entry_no": "Int64"})
        for b in batches:
            rows, held = [], 0
            for zip_name, content in zip(b["file_name"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        last = {_name(i): i for i in z.infolist()}
                        for no, (entry, info) in enumerate(last.items()):
                            ext = entry.lower().rsplit(".", 1)[-1] if "." in entry else ""
                            if entry.endswith("/") or ext not in ("pdf", "html", "htm"):
                                continue
                            try:
                                rows.append((zip_name, no, entry, ext, z.read(info), None))
                                held += info.file_size
                                if held > OPEN_BYTES:
                                    yield frame(rows)
                                    rows, held = [], 0
                            except Exception as e:  # an unreadable entry doesn't fail the archive
                                rows.append((zip_name, no, entry, ext, None, str(e)))
                except zipfile.BadZipFile as e:
                    rows.append((zip_name, None, None, None, None, str(e)))
            yield frame(rows)

    return files.select("file_name", "content").mapInPandas(run, "zip_name string, entry_no bigint, entry_name string, ext string, content binary, error string")


def flatten_recognised(regions: Column) -> Column:
    """Text of one page's recognised regions: non-empty texts, stripped, one a line; null regions and pages give the empty text."""
    flat = F.flatten(F.filter(F.coalesce(regions, F.array().cast("array<array<struct<box:array<array<double>>,rec:struct<text:string,conf:double>>>>")), lambda x: x.isNotNull()))
    texts = F.filter(flat, lambda r: r["rec"]["text"].isNotNull() & (r["rec"]["text"] != ""))
    return F.array_join(F.transform(texts, lambda r: strip(r["rec"]["text"])), "\n")


def join_pages(pages: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, raw_text): non-empty pages of a file in order, a form feed between."""
    rows = pages.filter(F.col(text) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("ps"))
    return rows.select(key, F.array_join(F.transform("ps", lambda p: p["t"]), "\n\f\n").alias("raw_text"))


def recognise(files: DataFrame, render: Callable[[bytes, int], list[bytes]], make_ocr: Callable[[], Callable[[bytes], str]], settings: Settings | None = None) -> DataFrame:
    """(file_name, page_no, text) of (file_name, content): pages rendered and read; the recogniser is made once a task, a page
    that fails is empty."""
    dpi = (settings or Settings()).ocr_dpi

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ocr = make_ocr()
        for b in batches:
            rows = []
            for name, content in zip(b["file_name"], b["content"]):
                for no, page in enumerate(render(content, dpi)):
                    try:
                        rows.append((name, no, ocr(page)))
                    except Exception:
                        rows.append((name, no, ""))
            yield pd.DataFrame(rows, columns=["file_name", "page_no", "text"])

    return files.select("file_name", "content").mapInPandas(run, "file_name string, page_no int, text string")


Fetched = tuple[bytes, str, str]  # body, content type, final address


def fetch(urls: DataFrame, fetcher: Callable[[str, Settings], Fetched] = download, settings: Settings | None = None, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """Download results (url, success, source_type, content, text, filename, content_type, error) of (url): ``content`` holds
    PDFs, ``text`` the text of pages; every failure, pages without text included, is a row, never a failed task.

    ``fetcher`` raises ``TimeoutError`` or ``ConnectionError`` for what may be tried again (2 ** k seconds apart)."""
    import time

    s, pause = settings or Settings(), sleep or time.sleep

    def get(url: str) -> tuple:
        for k in range(s.retries + 1):
            try:
                body, ct, final = fetcher(url, s)
                if len(body) > s.max_url_bytes:
                    return None, ct, final, f"Downloaded file size exceeds max {s.max_url_bytes} bytes."
                return body, ct, final, None
            except (TimeoutError, ConnectionError) as e:
                if k == s.retries:
                    return None, None, url, f"Failed to download {url} after {k + 1} attempts. Last error: {str(e) or type(e).__name__}"
                pause(2.0**k)
            except Exception as e:
                return None, None, url, str(e) or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for u, e in zip(b["url"], b["refused"]):  # one body at a time leaves the worker
                got = (None, None, u, f"URL validation failed: {e}") if e else get(u)
                yield pd.DataFrame([(u, *got)], columns=["url", "content", "content_type", "final_url", "error"])

    asked = urls.select("url", F.nullif(url_error(F.col("url")), F.lit("")).alias("refused"))
    asked = asked.repartition(s.max_downloads)
    got = asked.mapInPandas(run, "url string, content binary, content_type string, final_url string, error string")
    ct = F.coalesce("content_type", F.lit(""))
    kind = F.when(F.col("error").isNotNull(), None).when(is_pdf_content(ct, F.col("final_url")), "http_pdf").when(is_html_content(ct), "http_html")
    page = F.when(F.lit(s.html_mode != "skip") & (F.col("kind") == "http_html"), html.extract(F.when(F.col("kind") == "http_html", F.col("content")), F.col("content_type")))
    read = got.withColumn("kind", kind).withColumn("text", page)
    # Messages.
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("kind").isNull(), F.concat(F.lit("Unsupported content type '"), ct, F.lit("'. Only PDF and HTML are accepted.")))
        .when((F.col("kind") == "http_html") & F.lit(s.html_mode == "skip"), "HTML extraction is disabled (html_extraction_mode=skip).")
        .when((F.col("kind") == "http_html") & (strip(F.coalesce("text", F.lit(""))) == ""), "HTML page contains no extractable text.")
    )
    return read.select(
        "url", error.isNull().alias("success"), F.col("kind").alias("source_type"), F.when(F.col("kind") == "http_pdf", F.col("content")).alias("content"), "text",
        F.when(F.col("content_type").isNotNull(), derive_filename(F.col("final_url"), ct)).alias("filename"), "content_type", error.alias("error"),
    )
