"""URL and content-type functions as Column expressions; split by the generic URI grammar, so blanks and ``_`` are no obstacle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.pytext import expand, sql_quote, sql_strip, strip

# Grammar, media types, refused hosts and host prefixes, messages.
SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
PDF_TYPES = ("application/pdf", "application/x-pdf", "application/octet-stream")
HTML_TYPES = ("text/html", "application/xhtml+xml")
INTERNAL = ("localhost", "0.0.0.0", "[::]", "::1", "[::1]")
PRIVATE = r"^(?:127\.|10\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.|169\.254\.|0\.)"
EMPTY_URL = "URL is empty or not a string."
UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'
MAX_NAME = 200


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, SCHEME, 1))


def host(u: Column) -> Column:
    """Host in lower case: authority without user, port and brackets."""
    a = F.regexp_replace(F.regexp_extract(u, AUTHORITY, 1), "^.*@", "")
    v6 = F.regexp_extract(a, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(a.startswith("["), v6).otherwise(F.regexp_replace(a, ":.*$", "")))


def path(u: Column) -> Column:
    """Path without parameters of its last segment."""
    p = F.regexp_extract(u, PATH, 1)
    return F.regexp_replace(p, r";[^/]*$", "")


def query(u: Column) -> Column:
    return F.regexp_extract(u, QUERY, 1)


def url_error(u: Column) -> Column:
    """Why an address is refused; empty if it is not."""
    s = strip(u)
    sch, h = scheme(s), host(s)
    return (
        F.when(u.isNull() | (u == ""), EMPTY_URL)
        .when(~sch.isin("http", "https"), F.concat(F.lit("Unsupported scheme '"), sch, F.lit("'. Only http and https are accepted.")))
        .when(h == "", "URL has no hostname.")
        .when(h.isin(*INTERNAL), F.concat(F.lit("Internal hostname '"), h, F.lit("' is not allowed.")))
        .when(h.rlike(PRIVATE), F.concat(F.lit("Private/internal IP '"), h, F.lit("' is not allowed.")))
        .otherwise("")
    )


def validate_url(u: Column) -> Column:
    e = url_error(u)
    return F.struct((e == "").alias("is_valid"), e.alias("error"))


def media_type(ct: Column) -> Column:
    return strip(F.substring_index(F.lower(ct), ";", 1))


def is_pdf_content(ct: Column, u: Column) -> Column:
    m = media_type(ct)
    octet = (m == "application/octet-stream") & ((F.coalesce(u, F.lit("")) == "") | F.lower(path(u)).endswith(".pdf"))
    return m.isin("application/pdf", "application/x-pdf") | octet


def is_html_content(ct: Column) -> Column:
    return media_type(ct).isin(*HTML_TYPES)


def split_extension(name: Column) -> Column:
    """(stem, ext): at the last dot; no dot, no extension."""
    return F.struct(
        F.when(name.contains("."), F.regexp_extract(name, r"(?s)^(.*)(\.[^.]*)$", 1)).otherwise(name).alias("stem"), F.regexp_extract(name, r"(?s)^(.*)(\.[^.]*)$", 2).alias("ext")
    )


def derive_filename(u: Column, ct: Column) -> Column:
    """Safe file name: last path segment, or host and a digest of the address; extension by content type."""
    last = F.substring_index(F.regexp_replace(path(u), "^/+|/+$", ""), "/", -1)
    name = strip(F.regexp_replace(last, UNSAFE, "_"))
    h = F.when(host(u) == "", "unknown").otherwise(host(u))
    name = F.when((name == "") | ~name.contains("."), F.concat_ws("_", h, F.substring(F.md5(u.cast("binary")), 1, 12))).otherwise(name)
    s = split_extension(name)
    cut = F.concat(F.substring(s["stem"], F.lit(1), F.greatest(F.lit(0), MAX_NAME - F.length(s["ext"]))), s["ext"])
    name = F.when(F.length(name) > MAX_NAME, cut).otherwise(name)
    m, low = media_type(F.coalesce(ct, F.lit(""))), F.lower(name)
    return (
        F.when(m.isin(*PDF_TYPES) & ~low.endswith(".pdf"), F.concat(name, F.lit(".pdf")))
        .when(m.isin(*HTML_TYPES) & ~(low.endswith(".html") | low.endswith(".htm")), F.concat(name, F.lit(".html")))
        .otherwise(name)
    )


def url_key(u: Column) -> Column:
    """What two spellings of one address share; fragment, port, user and parameters don't count."""
    q = query(u)
    return F.concat(scheme(u), F.lit("://"), host(u), F.regexp_replace(path(u), "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def deduplicate_urls(df: DataFrame, url_col: str = "url", order_col: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    """First spelling of each address (within ``by``), stripped; aggregates before the shuffle, so a hot address is one row a task."""
    u = strip(F.col(url_col))
    rows = df.select(*by, F.col(order_col).alias("__o"), u.alias("__u")).filter("__u <> ''").withColumn("__k", url_key(F.col("__u")))
    first = rows.groupBy(*by, "__k").agg(F.min(F.struct("__o", "__u")).alias("m"))
    return first.select(*by, F.col("m.__o").alias(order_col), F.col("m.__u").alias(url_col))


def admit(df: DataFrame, url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): rows split by :func:`validate_url`; the invalid side carries ``error``."""
    checked = df.withColumn("error", url_error(F.col(url_col)))
    return checked.filter("error = ''").drop("error"), checked.filter("error <> ''")


# --- SQL ------------------------------------------------------------------------------------------------------------


def sql_scheme(e: str) -> str:
    return f"lower(regexp_extract({e}, {sql_quote(SCHEME)}, 1))"


def sql_host(e: str) -> str:
    a = f"regexp_replace(regexp_extract({e}, {sql_quote(AUTHORITY)}, 1), '^.*@', '')"
    return f"lower(CASE WHEN starts_with({a}, '[') THEN regexp_extract({a}, '^\\[([^\\]]*)\\]', 1) ELSE regexp_replace({a}, ':.*$', '') END)"


def sql_path(e: str) -> str:
    return f"regexp_replace(regexp_extract({e}, {sql_quote(PATH)}, 1), ';[^/]*$', '')"


def sql_url_error(e: str) -> str:
    s = sql_strip(e)
    sch, h = sql_scheme(s), sql_host(s)
    return (
        f"CASE WHEN {e} IS NULL OR {e} = '' THEN {sql_quote(EMPTY_URL)} WHEN {sch} NOT IN ('http', 'https') THEN 'Unsupported scheme ''' || {sch} || '''. Only http and https are accepted.' "
        f"WHEN {h} = '' THEN 'URL has no hostname.' WHEN {h} IN ({', '.join(map(sql_quote, INTERNAL))}) THEN 'Internal hostname ''' || {h} || ''' is not allowed.' "
        f"WHEN regexp_matches({h}, {sql_quote(PRIVATE)}) THEN 'Private/internal IP ''' || {h} || ''' is not allowed.' ELSE '' END"
    )


def sql_url_key(e: str) -> str:
    q = f"regexp_extract({e}, {sql_quote(QUERY)}, 1)"
    return f"({sql_scheme(e)} || '://' || {sql_host(e)} || regexp_replace({sql_path(e)}, '/+$', '') || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"


def sql_filename(u: str, ct: str) -> str:
    last = f"list_extract(string_split(regexp_replace({sql_path(u)}, '^/+|/+$', '', 'g'), '/'), -1)"
    name = sql_strip(f"regexp_replace({last}, {sql_quote(UNSAFE)}, '_', 'g')")
    h = sql_host(u)
    base = f"CASE WHEN {name} = '' OR NOT contains({name}, '.') THEN (CASE WHEN {h} = '' THEN 'unknown' ELSE {h} END) || '_' || substr(md5({u}), 1, 12) ELSE {name} END"
    m = sql_strip(f"split_part(lower({ct}), ';', 1)")
    pdf, html = (", ".join(map(sql_quote, x)) for x in (PDF_TYPES, HTML_TYPES))
    return (
        f"(SELECT CASE WHEN {m} IN ({pdf}) AND NOT ends_with(lower(b), '.pdf') THEN b || '.pdf' "
        f"WHEN {m} IN ({html}) AND NOT (ends_with(lower(b), '.html') OR ends_with(lower(b), '.htm')) THEN b || '.html' ELSE b END FROM (SELECT {base} AS b))"
    )
