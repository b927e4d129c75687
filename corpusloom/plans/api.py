"""The engine's functions: extract files, archives and addresses to records, look up status, read results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.pytext import strip
from corpusloom.functions.urls import deduplicate_urls, url_error
from corpusloom.operators import html
from corpusloom.plans.jobs import job_status, lookup
from corpusloom.plans.pipelines import route
from corpusloom.session import cut
from corpusloom.settings import Settings
from corpusloom.sources import files
from corpusloom.sources.http import download
from corpusloom.sources.sinks import resolve_output, write_jsonl

DOC_TYPES = ("patent", "regulation")


class Refused(ValueError):
    """A request that cannot be served, with the status a web front would give."""

    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


def _check(doc_type: str) -> None:
    if doc_type not in DOC_TYPES:
        raise Refused(400, f"doc_type must be one of {DOC_TYPES}")


def _read_pdfs(pdfs: DataFrame, render, make_ocr, settings: Settings) -> DataFrame:
    if render is None or make_ocr is None:
        raise Refused(400, "PDF files need a page renderer and a recogniser")
    return files.join_pages(files.recognise(pdfs, render, make_ocr, settings), "file_name", "page_no", "text").withColumnRenamed("raw_text", "text")


def extract_documents(
    spark: SparkSession, path: str, doc_type: str = "patent", render: Callable | None = None, make_ocr: Callable | None = None, settings: Settings | None = None
) -> tuple[DataFrame, DataFrame]:
    """(records, results) of the PDF, HTML and ZIP files under a path: records (file_name, source, doc_type, seg_no, text,
    category); results (file_name, source, status, record_count, error), one row a document, those that failed and files and
    archives that are refused included."""
    _check(doc_type)
    s = settings or Settings()
    found = files.scan(spark, path, s)
    entries = cut(files.unzip(found.filter("reason is null and ext = 'zip'")))
    name = F.concat_ws("/", "zip_name", "entry_name")
    zipped = entries.filter("error is null").select(name.alias("file_name"), "ext", "content", F.lit("zip_").alias("from"))
    all_files = found.filter("reason is null and ext <> 'zip'").select("file_name", "ext", "content", F.lit("local_").alias("from")).unionByName(zipped)
    pages = all_files.filter("ext in ('html', 'htm')").select("file_name", F.concat("from", F.lit("html")).alias("source"), html.extract(F.col("content"), F.lit("")).alias("text"))
    pdfs = all_files.filter("ext = 'pdf'")
    asked = pdfs.select("file_name", F.concat("from", F.lit("pdf")).alias("source"))
    docs = pages
    if render is not None:
        docs = docs.unionByName(_read_pdfs(pdfs, render, make_ocr, s).join(asked, "file_name").select("file_name", "source", "text"))
    docs = cut(docs)
    records = route(docs.filter(strip(F.col("text")) != "").withColumn("doc_type", F.lit(doc_type)), settings=s)
    counts = records.groupBy("file_name").agg(F.count("*").alias("n"))
    known = pages.select("file_name", "source").unionByName(asked).join(docs.select("file_name", "text"), "file_name", "left").join(counts, "file_name", "left")
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    pdf = F.col("source").endswith("pdf")
    # Messages.
    error = F.when(pdf & F.lit(render is None), "PDF files need a page renderer and a recogniser").when(pdf & (blank | F.col("n").isNull()), "OCR produced no text. The PDF may be unreadable.")
    error = error.when(blank, "HTML file contains no extractable text.").when(F.col("n").isNull(), "HTML text extraction produced no usable content.")
    done = known.select("file_name", "source", F.when(error.isNull(), "success").otherwise("failed").alias("status"), F.coalesce("n", F.lit(0)).alias("record_count"), error.alias("error"))
    why = F.when(F.col("reason") == "extension", "Unsupported file type. Only .pdf, .html, .htm and .zip are accepted.").when(F.col("reason") == "empty", "Empty file.").otherwise(f"File exceeds {s.max_upload_bytes >> 20} MB limit.")
    none = F.lit(0).cast("bigint").alias("record_count")
    refused = found.filter("reason is not null").select("file_name", F.lit(None).cast("string").alias("source"), F.lit("failed").alias("status"), none, why.alias("error"))
    broken = entries.filter("error is not null").select(name.alias("file_name"), F.lit(None).cast("string").alias("source"), F.lit("failed").alias("status"), none, F.when(F.col("entry_name").isNull(), "Invalid ZIP file.").otherwise(F.col("error")).alias("error"))
    return records, done.unionByName(refused).unionByName(broken)


def extract_files(
    spark: SparkSession, path: str, doc_type: str = "patent", render: Callable | None = None, make_ocr: Callable | None = None, settings: Settings | None = None
) -> DataFrame:
    """The records of :func:`extract_documents`."""
    return extract_documents(spark, path, doc_type, render, make_ocr, settings)[0]


def extract_urls(
    urls: DataFrame, fetcher: Callable = download, doc_type: str = "patent", render: Callable | None = None, make_ocr: Callable | None = None, settings: Settings | None = None
) -> tuple[DataFrame, DataFrame]:
    """(records, results) of a list (pos, url): refused addresses are skipped, duplicates fetched once, failures are results.

    What was downloaded is written once to the shared folder, so no later step asks an address again."""
    _check(doc_type)
    s = settings or Settings()
    checked = urls.withColumn("error", url_error(F.col("url")))
    skipped = checked.filter("error <> ''").select("url", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("filename"), "error", F.lit(None).cast("string").alias("source_type"))
    got = cut(files.fetch(deduplicate_urls(checked.filter("error = ''")), fetcher, s))
    docs = got.filter("success and source_type = 'http_html'").select("url", "text", "source_type")
    if render is not None:
        read = _read_pdfs(got.filter("success and source_type = 'http_pdf'").select(F.col("url").alias("file_name"), "content"), render, make_ocr, s)
        docs = docs.unionByName(read.select(F.col("file_name").alias("url"), "text", F.lit("http_pdf").alias("source_type")))
    docs = docs.filter(strip(F.col("text")) != "").withColumn("doc_type", F.lit(doc_type))
    records = route(docs, settings=s)
    counts = records.groupBy("url").count()
    done = got.join(counts, "url", "left").select("url", F.when(F.col("success"), "success").otherwise("failed").alias("status"), "filename", "error", "source_type", F.coalesce("count", F.lit(0)).alias("record_count"))
    return records, skipped.withColumn("record_count", F.lit(0).cast("bigint")).unionByName(done)


@dataclass(frozen=True)
class Extracted:
    """What one request gives: the name of the written result, how many records it holds, the first of them."""

    filename: str
    record_count: int
    preview: list[dict]
    source: str
    source_url: str = ""


def _written(records: DataFrame, name: str, none: str, source: str, settings: Settings, source_url: str = "") -> Extracted:
    kept = cut(records)
    n = kept.count()
    if not n:
        raise Refused(400, none)
    write_jsonl(kept, f"{settings.output_dir}/{name}", single=True)
    first = kept.orderBy("seg_no").limit(3).select("text", "category").collect()
    return Extracted(name, n, [r.asDict() for r in first], source, source_url)


def _stamp() -> str:
    return datetime.now().strftime("%Y%m%d_%H%M%S")


def extract_file(
    spark: SparkSession, path: str, doc_type: str = "patent", render: Callable | None = None, make_ocr: Callable | None = None, settings: Settings | None = None
) -> Extracted:
    """One PDF or HTML file to a written result; whatever leaves no record is refused with its reason."""
    s = settings or Settings()
    records, results = extract_documents(spark, path, doc_type, render, make_ocr, s)
    rows = results.limit(2).collect()
    if len(rows) != 1:
        raise Refused(400, "Empty file." if not rows else "not a single document")
    if rows[0].status != "success":
        raise Refused(413 if "exceeds" in rows[0].error else 400, rows[0].error)
    stem = rows[0].file_name.rpartition(".")[0]
    return _written(records, f"{'reg_' if doc_type == 'regulation' else ''}{stem}_{_stamp()}.jsonl", rows[0].error or "", rows[0].source, s)


def extract_archive(
    spark: SparkSession, path: str, doc_type: str = "patent", render: Callable | None = None, make_ocr: Callable | None = None, settings: Settings | None = None
) -> tuple[Extracted, DataFrame]:
    """One ZIP file to a written result (empty where no document gives a record), and the result of every document."""
    s = settings or Settings()
    records, results = extract_documents(spark, path, doc_type, render, make_ocr, s)
    results = cut(results)
    if results.filter("error = 'Invalid ZIP file.'").count():
        raise Refused(400, "Invalid ZIP file.")
    if not results.count():
        raise Refused(400, "ZIP contains no PDF or HTML files.")
    kept = cut(records)
    stem = path.rstrip("/").rpartition("/")[2].rpartition(".")[0]
    name = f"{'reg_' if doc_type == 'regulation' else 'batch_'}{stem}_{_stamp()}.jsonl"
    write_jsonl(kept, f"{s.output_dir}/{name}", single=True)
    first = kept.orderBy("file_name", "seg_no").limit(3).select("text", "category").collect()
    return Extracted(name, kept.count(), [r.asDict() for r in first], "zip"), results


def extract_url(
    spark: SparkSession, url: str, doc_type: str = "patent", fetcher: Callable = download, render: Callable | None = None, make_ocr: Callable | None = None, settings: Settings | None = None
) -> Extracted:
    """One address to a written result; refused with the error's text where the download fails or leaves no record."""
    s = settings or Settings()
    records, results = extract_urls(spark.createDataFrame([(0, url)], "pos int, url string"), fetcher, doc_type, render, make_ocr, s)
    rows = results.collect()
    if not rows or rows[0].status == "failed":
        raise Refused(400, f"Failed to process URL: {rows[0].error if rows else 'URL is empty or not a string.'}")
    if rows[0].status == "skipped":
        raise Refused(400, f"Failed to process URL: URL validation failed: {rows[0].error}")
    none = "OCR produced no text. The downloaded PDF may be unreadable." if rows[0].source_type == "http_pdf" else "HTML text extraction produced no usable content."
    stem = rows[0].filename.rpartition(".")[0] or rows[0].filename
    return _written(records, f"{stem}_{_stamp()}.jsonl", none, rows[0].source_type, s, url)


def task_status(reports: DataFrame, task_id: str) -> dict:
    """State of one task; an unknown one is refused."""
    rows = lookup(job_status(reports), task_id).collect()
    if not rows:
        raise Refused(404, "Task not found.")
    return rows[0].asDict()


def read_output(name: str, settings: Settings | None = None):
    """Path of a written result inside the output folder."""
    try:
        return resolve_output((settings or Settings()).output_dir, name)
    except PermissionError:
        raise Refused(403, "Invalid filename.") from None
    except FileNotFoundError:
        raise Refused(404, "File not found.") from None
