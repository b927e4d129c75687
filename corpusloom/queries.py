"""Registered queries of the engine's own operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import quality, urls
from corpusloom.functions.pytext import lines, sql_match, sql_quote, sql_strip
from corpusloom.operators import html, patent, regulation, segment
from corpusloom.plans import jobs, pipelines
from corpusloom.session import spread, table
from corpusloom.settings import Settings
from corpusloom.sources import files, sinks, url_lists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
S = Settings()


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


#: Lines set before and after every text, so that each stage meets what it is made for; <id> stands for the row's key.
PATENT_BEFORE = (
    "(19) 国家知识产权局", "(12) 发明专利申请", "江苏某某科技有限公司", "张三丰 李四光 王五一", "(21) 申请号 2012<id>", "G06Q 30/08 (2012.01)", "摘要",
    "本发明公开了一种招", "标文件的生成方法。", "X", "NN 017 A", "<id>", "第 <id> 页", "-＝=+|", "、、12 <id>3456", "技术领域：", "[0001]",
    "本发明涉及招标<id>领域。", "CN 102955986 A", "说明书", "4/6页", "[0002] 第二段说明。", "", "一、背景", "1101-194T2020<id>99",
)
PATENT_AFTER = (
    "\f", "权利要求书", "CN 102955986 A", "1/2页", "1. 一种方法，其包", "括如下步骤<id>。", "权利要求书", "2/2页", "2. 根据权利要求1所述的方法。", "", "",
    "权利要求书 2 页 说明书 6 页 附图 3 页", "11 代理人张某<id>", "以上所述仅为本发明的较佳实施例，不用于限制。余文<id>", "权利要求书1页说明书5页", "CN 10295<id>123 A", "地址 某市某路<id>号",
)
REGULATION_BEFORE = (
    "【发布稿】", "关于<id>号文【附件】的通知", "====++====", "|----------|", "□▲。。", "□□", "京", "<id>", "07", "13800138<id>", "甲级", "联系人", "2020-123456<id>AB",
    "第二条", "（三）", "ab", "\ufeff零宽\u200b不见\u00a0空格", "æåå¤§å­¦ç<id>", "┌──┬──┐", "甲 ─ 乙",
)
REGULATION_AFTER = ("", "", "一、总则", "应当保存<id>记录。", "  二、附则", "自发布之日起施行。", "", "", "联系电话", "12", "优秀")


def _frame(kind: str) -> tuple[str, str]:
    before, after = (REGULATION_BEFORE, REGULATION_AFTER) if kind == "regulation" else (PATENT_BEFORE, PATENT_AFTER)
    return "\n".join(before) + "\n", "\n" + "\n".join(after)


def decoration(key: str, kind: str) -> Column:
    """The text between the lines of its kind."""
    head, tail = (F.replace(F.lit(x), F.lit("<id>"), F.col(key).cast("string")) for x in _frame(kind))
    return F.concat(head, F.col("text"), tail)


def decorated(spark: SparkSession, sf_dir: str, source: str, key: str, kind: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, source).select(key, *more, decoration(key, kind).alias("text")))


def sql_decorated(source: str, key: str, kind: str, *more: str) -> str:
    head, tail = (f"replace({sql_quote(x)}, '<id>', CAST({key} AS VARCHAR))" for x in _frame(kind))
    return f"SELECT {', '.join((key, *more))}, {head} || text || {tail} AS text FROM {source}"


def text_query(name: str, kind: str, column: Callable, sql: Callable[[str], str], source: str = "pretrain", key: str = "record_id") -> None:
    """A query that rewrites the decorated text of a whole table."""
    register(
        name, lambda spark, d: decorated(spark, d, source, key, kind).select(key, column(F.col("text")).alias("text")),
        f"SELECT {key}, {sql('text')} AS text FROM ({sql_decorated(source, key, kind)})",
    )


# --- patent cleaning, stage by stage and whole ----------------------------------------------------------------------

for _stage in (*patent.BEFORE_JOIN, *patent.LINE_STAGES):
    text_query(f"patent_{_stage[0]}", "patent", lambda c, st=_stage: patent.apply_stage(c, st), lambda e, st=_stage: patent.sql_stage(e, st))
text_query("patent_join_lines", "patent", patent.join_broken_lines, patent.sql_join_broken_lines)
text_query("patent_attach_numbers", "patent", patent.attach_numbers, patent.sql_attach_numbers)
text_query("patent_footer_runs", "patent", patent.remove_footer_runs, patent.sql_remove_footer_runs)
text_query("patent_claims_footers", "patent", patent.remove_claims_footers, patent.sql_remove_claims_footers)
text_query("patent_fragments", "patent", patent.remove_fragments, patent.sql_remove_fragments)
text_query("patent_blanks", "patent", patent.normalise_blanks, patent.sql_normalise_blanks)
register(
    "patent_line_kinds",
    lambda spark, d: decorated(spark, d, "pretrain", "record_id", "patent").select("record_id", F.posexplode(lines(F.col("text"))).alias("line_no", "line"))
    .select("record_id", "line_no", patent.is_footer_line(F.col("line")).alias("footer"), patent.is_section_boundary(F.col("line")).alias("boundary")),
    f"SELECT record_id, CAST(i - 1 AS INTEGER) AS line_no, {patent.sql_is_footer('ls[i]')} AS footer, {sql_match(sql_strip('ls[i]'), patent.BOUNDARY)} AS boundary "
    f"FROM (SELECT record_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT record_id, string_split(text, chr(10)) AS ls FROM ({sql_decorated('pretrain', 'record_id', 'patent')})))",
)


def sql_patent_clean(source: str, key: str) -> str:
    """Steps whose last, ``cleaned``, has (key, text, cleaned)."""
    steps, prev, n = [f"p0 AS MATERIALIZED ({source})"], "p0", 0

    def add(expr: str) -> None:
        nonlocal prev, n
        n += 1
        steps.append(f"p{n} AS MATERIALIZED (SELECT {key}, text, {expr} AS s FROM {prev})")
        prev = f"p{n}"

    e = "text"
    for st in patent.BEFORE_JOIN:
        add(patent.sql_stage(e, st))
        e = "s"
    for f in (patent.sql_join_broken_lines, patent.sql_attach_numbers, patent.sql_remove_footer_runs, patent.sql_remove_claims_footers):
        add(f(e))
    for st in patent.LINE_STAGES:
        add(patent.sql_stage(e, st))
    for f in (patent.sql_remove_fragments, patent.sql_normalise_blanks):
        add(f(e))
    steps.append(f"cleaned AS MATERIALIZED (SELECT {key}, text, CASE WHEN {sql_strip('text')} = '' THEN '' ELSE s END AS cleaned FROM {prev})")
    return ", ".join(steps)


register(
    "patent_clean", lambda spark, d: decorated(spark, d, "pretrain", "record_id", "patent").select("record_id", patent.clean(F.col("text")).alias("text")),
    "WITH " + sql_patent_clean(sql_decorated("pretrain", "record_id", "patent"), "record_id") + " SELECT record_id, cleaned AS text FROM cleaned",
)


# --- regulation cleaning, stage by stage and whole ------------------------------------------------------------------

text_query("regulation_invisible", "regulation", regulation.strip_invisible, regulation.sql_strip_invisible)
text_query("regulation_garbled_lines", "regulation", regulation.drop_garbled_lines, regulation.sql_drop_garbled_lines)
text_query("regulation_short_lines", "regulation", regulation.drop_short_lines, regulation.sql_drop_short_lines)
for _rule in regulation.STAGES:
    if _rule[3]:
        text_query(f"regulation_{_rule[0]}", "regulation", lambda c, st=_rule: regulation.apply_stage(c, st), lambda e, st=_rule: patent.sql_replace(e, st[1], st[2]))
# the two rules that see a whole text are asked of every line of it
for _rule in regulation.STAGES:
    if not _rule[3]:
        text_query(
            f"regulation_{_rule[0]}", "regulation", lambda c, st=_rule: F.array_join(F.transform(lines(c), lambda x: regulation.apply_stage(x, st)), "\n"),
            lambda e, st=_rule: f"array_to_string(list_transform(string_split({e}, chr(10)), lambda y: {patent.sql_replace('y', st[1], st[2])}), chr(10))",
        )
_REGULATION = "d0 AS (" + sql_decorated("documents", "doc_id", "regulation", "doc_type") + "), " + regulation.sql_clean_steps("d0", "doc_id", "text")
_PATENT = sql_patent_clean(sql_decorated("documents", "doc_id", "patent", "doc_type"), "doc_id")
register(
    "regulation_clean", lambda spark, d: decorated(spark, d, "documents", "doc_id", "regulation").select("doc_id", regulation.clean(F.col("text")).alias("text")),
    "WITH " + _REGULATION + " SELECT doc_id, cleaned AS text FROM cleaned",
)

# --- segmentation ---------------------------------------------------------------------------------------------------

_RAW = {k: f"d AS ({sql_decorated('documents', 'doc_id', k)})" for k in ("patent", "regulation")}


def _explode(kind: str, column: Callable) -> Callable:
    return lambda spark, d: decorated(spark, d, "documents", "doc_id", kind).select("doc_id", F.posexplode(column(F.col("text"))).alias("no", "part"))


def _sql_explode(kind: str, parts: str, steps: str = "") -> str:
    return f"WITH {_RAW[kind]}{steps} SELECT doc_id, CAST(i - 1 AS INTEGER) AS no, ps[i] AS part FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM ({parts}))"


_ONE = ", gs AS (SELECT doc_id, 1 AS i, 1 AS j, text AS g FROM d), "
register(
    "patent_sections", _explode("patent", segment.split_sections),
    _sql_explode("patent", "SELECT doc_id, list(s ORDER BY i) AS ps FROM sec GROUP BY doc_id", ", " + segment.sql_section_steps("d", "doc_id", "text")),
)
register("patent_paragraphs", _explode("patent", segment.split_paragraphs), _sql_explode("patent", f"SELECT doc_id, {segment.sql_paragraphs('text')} AS ps FROM d"))
for _kind, _split in (("patent", segment.split_long), ("regulation", segment.split_long_regulation)):
    register(
        f"{_kind}_long_split", _explode(_kind, lambda c, f=_split: F.when(F.length(c) > 600, f(c, 600))),
        _sql_explode(_kind, "SELECT doc_id, parts AS ps FROM lp", _ONE + segment.sql_long_steps("doc_id", 600, _kind == "patent")),
    )
register(
    "regulation_raw_segments", _explode("regulation", lambda c: segment.segment_regulation(c, S.min_length, 600)),
    _sql_explode("regulation", "SELECT doc_id, list(segment ORDER BY seg_no) AS ps FROM segments GROUP BY doc_id", ", " + segment.sql_segment_steps("d", "doc_id", "text", "regulation", S.min_length, 600)),
)
# the blank-line rule of texts without numbered sections, which cleaning never leaves
_PLAIN = "SELECT doc_id, regexp_replace(text, '[、．.]', '', 'g') AS text FROM documents"
register(
    "regulation_plain_segments",
    lambda spark, d: spread(table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[、．.]", "").alias("text"))).select(
        "doc_id", F.posexplode(segment.segment_regulation(F.col("text"), S.min_length, 600)).alias("no", "part")
    ),
    f"WITH d AS ({_PLAIN}), {segment.sql_segment_steps('d', 'doc_id', 'text', 'regulation', S.min_length, 600)} SELECT doc_id, seg_no AS no, segment AS part FROM segments",
)


def _sql_records(kind: str, category: str, where: str = "true") -> str:
    reason = quality.sql_reject_reason("segment", S.min_length, kind == "patent")
    return f"SELECT doc_id, seg_no, segment AS text, {sql_quote(category)} AS category FROM segments WHERE {reason} IS NULL AND {where}"


_SEGMENTS = {k: f"WITH {c}, " + segment.sql_segment_steps("cleaned", "doc_id", "cleaned", k, S.min_length, S.max_length) for k, c in (("patent", _PATENT), ("regulation", _REGULATION))}
_CATEGORY = {"patent": S.patent_category, "regulation": S.regulation_category}
for _kind in ("patent", "regulation"):
    _docs = lambda spark, d, k=_kind: decorated(spark, d, "documents", "doc_id", k)
    register(f"{_kind}_segments", lambda spark, d, k=_kind, f=_docs: pipelines.segments(f(spark, d), k), _SEGMENTS[_kind] + " SELECT doc_id, seg_no, segment FROM segments")
    register(f"{_kind}_records", lambda spark, d, k=_kind, f=_docs: pipelines.records(f(spark, d), k), _SEGMENTS[_kind] + " " + _sql_records(_kind, _CATEGORY[_kind]))
    register(
        f"{_kind}_funnel", lambda spark, d, k=_kind, f=_docs: pipelines.reject_funnel(f(spark, d), k),
        _SEGMENTS[_kind] + f" SELECT coalesce({quality.sql_reject_reason('segment', S.min_length, _kind == 'patent')}, 'kept') AS reason, count(*) AS segments FROM segments GROUP BY 1",
    )
register(
    "regulation_preview", lambda spark, d: pipelines.preview(pipelines.records(decorated(spark, d, "documents", "doc_id", "regulation"), "regulation"), "doc_id"),
    _SEGMENTS["regulation"] + " " + _sql_records("regulation", S.regulation_category) + " ORDER BY doc_id, seg_no LIMIT 3",
)


def _sql_routed() -> str:
    def side(kind: str, where: str) -> str:
        steps = _SEGMENTS[kind].replace("FROM documents", f"FROM documents WHERE {where}")
        return f"SELECT doc_id, doc_type, seg_no, text, category FROM ({steps} {_sql_records(kind, _CATEGORY[kind])}) JOIN (SELECT doc_id, doc_type FROM documents) USING (doc_id)"

    return side("regulation", "doc_type = 'regulation'") + " UNION ALL " + side("patent", "(doc_type <> 'regulation' OR doc_type IS NULL)")


def _routed(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_type") == "regulation", decoration("doc_id", "regulation")).otherwise(decoration("doc_id", "patent"))
    return pipelines.route(spread(table(spark, d, "documents").select("doc_id", "doc_type", text.alias("text"))))


register("routed_records", _routed, _sql_routed())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to regulation records, end to end."""
    return QUERIES["regulation_records"](spark, sf_dir)


# --- quality --------------------------------------------------------------------------------------------------------

register(
    "mojibake_flags", lambda spark, d: table(spark, d, "pretrain").select("record_id", quality.is_mojibake(F.col("text")).alias("mojibake")),
    f"SELECT record_id, {quality.sql_is_mojibake('text')} AS mojibake FROM pretrain",
)
for _kind in ("patent", "regulation"):
    register(
        f"{_kind}_reject_reason",
        lambda spark, d, k=_kind: table(spark, d, "pretrain").select("record_id", F.coalesce(quality.reject_reason(F.col("text"), S.min_length, k == "patent"), F.lit("kept")).alias("reason")),
        f"SELECT record_id, coalesce({quality.sql_reject_reason('text', S.min_length, _kind == 'patent')}, 'kept') AS reason FROM pretrain",
    )

# --- addresses ------------------------------------------------------------------------------------------------------

register(
    "url_validate", lambda spark, d: table(spark, d, "url_submission").select("task_id", "pos", urls.url_error(F.col("url")).alias("error")),
    f"SELECT task_id, pos, {urls.sql_url_error('url')} AS error FROM url_submission",
)
_U = sql_strip("url")
_DEDUPE = f"SELECT task_id, min(pos) AS pos, arg_min(u, pos) AS url FROM (SELECT task_id, pos, {_U} AS u FROM url_submission) WHERE u <> '' GROUP BY task_id, {urls.sql_url_key('u')}"
register("url_dedupe", lambda spark, d: urls.deduplicate_urls(table(spark, d, "url_submission"), by=("task_id",)), _DEDUPE)


def _admission(spark, d):
    valid, invalid = urls.admit(table(spark, d, "url_submission"))
    kept = urls.deduplicate_urls(valid, by=("task_id",)).groupBy("task_id").agg(F.count("*").alias("accepted"))
    refused = invalid.groupBy("task_id").agg(F.count("*").alias("refused"), F.min_by("error", "pos").alias("first_error"))
    return kept.join(refused, "task_id", "full").select("task_id", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("refused", F.lit(0)).alias("refused"), "first_error")


register(
    "url_admission", _admission,
    f"WITH c AS (SELECT task_id, pos, url, {_U} AS u, {urls.sql_url_error('url')} AS error FROM url_submission), "
    f"k AS (SELECT task_id, count(DISTINCT {urls.sql_url_key('u')}) AS accepted FROM c WHERE error = '' GROUP BY task_id), "
    "r AS (SELECT task_id, count(*) AS refused, arg_min(error, pos) AS first_error FROM c WHERE error <> '' GROUP BY task_id) "
    "SELECT coalesce(k.task_id, r.task_id) AS task_id, coalesce(accepted, 0) AS accepted, coalesce(refused, 0) AS refused, first_error FROM k FULL JOIN r ON k.task_id = r.task_id",
)
_CT = "CASE WHEN source_type = 'http_pdf' THEN 'Application/PDF; q=1' WHEN source_type = 'http_html' THEN 'text/html; charset=utf-8' WHEN finished_at IS NULL THEN '' ELSE 'application/octet-stream' END"
register(
    "url_filename", lambda spark, d: table(spark, d, "url_result").withColumn("ct", F.expr(_CT)).select("task_id", "url", urls.derive_filename(F.col("url"), F.col("ct")).alias("name")),
    f"SELECT task_id, url, {urls.sql_filename('url', 'ct')} AS name FROM (SELECT *, {_CT} AS ct FROM url_result)",
)
_M = sql_strip("split_part(lower(ct), ';', 1)")
register(
    "content_type_route",
    lambda spark, d: table(spark, d, "url_result").withColumn("ct", F.expr(_CT)).select("task_id", "url", urls.is_pdf_content(F.col("ct"), F.col("url")).alias("pdf"), urls.is_html_content(F.col("ct")).alias("html")),
    f"SELECT task_id, url, {_M} IN ('application/pdf', 'application/x-pdf') OR ({_M} = 'application/octet-stream' AND (url = '' OR ends_with(lower({urls.sql_path('url')}), '.pdf'))) AS pdf, "
    f"{_M} IN ('text/html', 'application/xhtml+xml') AS html FROM (SELECT *, {_CT} AS ct FROM url_result)",
)
register(
    "url_split_extension", lambda spark, d: table(spark, d, "url_result").filter("filename is not null").select("task_id", "filename", urls.split_extension(F.col("filename"))["ext"].alias("ext")),
    r"SELECT task_id, filename, regexp_extract(filename, '(?s)^(.*)(\.[^.]*)$', 2) AS ext FROM url_result WHERE filename IS NOT NULL",
)
register(
    "url_list_txt", lambda spark, d: table(spark, d, "url_submission").select("task_id", "pos", url_lists.url_in_line(F.concat(F.lit("  see "), F.col("url"), F.lit(")."))).alias("found")),
    f"""SELECT task_id, pos, CASE WHEN f <> '' THEN f END AS found FROM (SELECT task_id, pos, regexp_replace(regexp_extract('  see ' || url || ').', 'https?://{url_lists.NOT_WS}+', 0), {sql_quote(url_lists.TRAIL)}, '') AS f FROM url_submission)""",
)


def _url_list_json(spark, d):
    lists = table(spark, d, "url_submission").groupBy("task_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "url")))).alias("content"))
    return lists.select("task_id", F.explode(url_lists.parse_json(F.col("content"))).alias("url"))


register("url_list_json", _url_list_json, "SELECT task_id, url FROM url_submission WHERE starts_with(url, 'http')")


def _lists(spark, d, line):
    """(task_id, content): one list file a task, a line an address."""
    rows = table(spark, d, "url_submission").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("x"))
    return rows.select("task_id", F.array_join(F.transform("x", lambda x: line(x["pos"], x["url"])), "\n").alias("content"))


_HTTP = f"regexp_matches({sql_strip('url')}, '^https?://')"
register(
    "url_list_csv",
    lambda spark, d: _lists(spark, d, lambda pos, url: F.concat(F.lit('"'), F.replace(url, F.lit('"'), F.lit('""')), F.lit('",'), pos)).select("task_id", F.explode(url_lists.parse_csv(F.col("content"))).alias("url")),
    f"SELECT task_id, {sql_strip('url')} AS url FROM url_submission WHERE {_HTTP}",
)


def _url_list_object(spark, d):
    rows = table(spark, d, "url_submission").filter("url is not null").groupBy("task_id").agg(F.array_sort(F.collect_list("url")).alias("urls"), F.min("url").alias("first"), F.lit("no address").alias("note"))
    return rows.select("task_id", F.explode(url_lists.parse_json(F.to_json(F.struct("urls", "first", "note")))).alias("url"))


register(
    "url_list_object", _url_list_object,
    "SELECT task_id, url FROM url_submission WHERE starts_with(url, 'http') UNION ALL SELECT task_id, f AS url FROM (SELECT task_id, min(url) AS f FROM url_submission GROUP BY task_id) WHERE starts_with(f, 'http')",
)
#: The same address as a list file of each kind.
_KINDS = {"txt": ("", ""), "CSV": ('"', '",1'), ".json": ('["', '"]'), "doc": ("", "")}


def _dispatch(spark, d):
    clean = table(spark, d, "url_submission").filter(F.col("url").rlike("^https?://[!#-;=?-\\[\\]_a-z~]+[a-z0-9]$"))
    kinds = F.array(*[F.struct(F.lit(k).alias("ext"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in _KINDS.items()])
    rows = clean.select("task_id", "pos", "url", F.explode(kinds).alias("k"))
    return rows.select("task_id", "pos", F.col("k.ext").alias("ext"), url_lists.parse_url_list(F.concat("k.x", "url", "k.y"), F.col("k.ext")).alias("urls")).select("task_id", "pos", "ext", F.get("urls", F.lit(0)).alias("url"))


register(
    "url_list_dispatch", _dispatch,
    r"SELECT task_id, pos, ext, CASE WHEN ext <> 'doc' THEN url END AS url FROM (SELECT task_id, pos, url, unnest(['txt', 'CSV', '.json', 'doc']) AS ext FROM url_submission WHERE regexp_matches(url, '^https?://[!#-;=?-\[\]_a-z~]+[a-z0-9]$'))",
)

# --- HTML -----------------------------------------------------------------------------------------------------------

#: What a page holds besides its text: every element that is removed, and both ways of hiding one.
_PAGE_HEAD = (
    "<html><head><title>t</title><script>var a = '<p>';</script><style>p { color: red }</style></head><body><noscript>no script</noscript><header>head <b>line</b></header>"
    "<nav><ul><li>menu</ul></nav><div style='margin: 0; DISPLAY : none'><p>hidden <i>part</i></div><span aria-hidden='true'>icon</span>"
)
_PAGE_TAIL = "<iframe src='x'>frame</iframe><svg><text>drawn</text></svg><aside>more</aside><!-- note --><footer>end<br>of page</footer></body></html>"


def _body() -> Column:
    escaped = lambda x: reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), x)
    return F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("<p>"), escaped(x), F.lit("</p>"))), "\n")


_BODY_TEXT = f"regexp_replace(array_to_string(list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda y: {sql_strip('y')}), lambda x: x <> ''), chr(10)), '[ \t]{{2,}}', ' ', 'g')"


def _html(spark, d):
    page = F.concat(F.lit("<!doctype html><meta charset='utf-8'>" + _PAGE_HEAD), _body(), F.lit(_PAGE_TAIL))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", html.extract(page.cast("binary"), F.lit("text/html")).alias("text"))


register("html_text", _html, f"SELECT doc_id, {sql_strip('s')} AS text FROM (SELECT doc_id, {_BODY_TEXT} AS s FROM documents)")


def _html_encodings(spark, d):
    """Each text as a page in several encodings, named by the header, by a meta tag, or by nothing."""
    page = F.concat(F.lit("<!doctype html>" + _PAGE_HEAD), _body(), F.lit(_PAGE_TAIL))
    latin = F.col("text").rlike("\\A[\\x00-\\x{ff}]*\\z")
    meta = F.concat(F.lit("<meta http-equiv=x content='text/html; charset=ISO-8859-1'>"), page)
    ways = F.array(
        F.struct(F.lit("plain").alias("way"), page.cast("binary").alias("b"), F.lit("text/html").alias("ct")),
        F.struct(F.lit("header").alias("way"), F.encode(page, "UTF-16LE").alias("b"), F.lit('text/html; charset="utf-16le"').alias("ct")),
        F.struct(F.lit("meta").alias("way"), F.when(latin, F.encode(meta, "ISO-8859-1")).alias("b"), F.lit("text/html; charset=no-such-codec").alias("ct")),
    )
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(ways).alias("w"))
    return rows.filter("w.b is not null").select("doc_id", F.col("w.way").alias("way"), html.extract(F.col("w.b"), F.col("w.ct")).alias("text"))


register(
    "html_encodings", _html_encodings,
    rf"SELECT doc_id, way, {sql_strip('s')} AS text FROM (SELECT doc_id, way, {_BODY_TEXT} AS s FROM (SELECT doc_id, text, unnest(['plain', 'header', 'meta']) AS way FROM documents) WHERE way <> 'meta' OR regexp_matches(text, '\A[\x00-\x{{ff}}]*\z'))",
)

# --- scanned pages --------------------------------------------------------------------------------------------------

_REGIONS = f"list_filter(flatten(list_filter(coalesce(regions, []), lambda g: g IS NOT NULL)), lambda r: r.rec.text IS NOT NULL AND r.rec.text <> '')"
_PAGE = f"coalesce(array_to_string(list_transform({_REGIONS}, lambda r: {sql_strip('r.rec.text')}), chr(10)), '')"
register(
    "ocr_flatten", lambda spark, d: table(spark, d, "ocr_page").select("page_id", files.flatten_recognised(F.col("regions")).alias("text")),
    f"SELECT page_id, {_PAGE} AS text FROM ocr_page",
)
register(
    "ocr_join_pages", lambda spark, d: files.join_pages(table(spark, d, "ocr_page").select("file_name", "page_no", files.flatten_recognised(F.col("regions")).alias("t")), "file_name", "page_no", "t"),
    f"SELECT file_name, string_agg(t, chr(10) || chr(12) || chr(10) ORDER BY page_no, t) AS raw_text FROM (SELECT file_name, page_no, {_PAGE} AS t FROM ocr_page) WHERE t <> '' GROUP BY file_name",
)

# --- jobs -----------------------------------------------------------------------------------------------------------

_STATUS = (
    "SELECT task_id, coalesce(arg_max(CASE WHEN status IN ('completed', 'failed') THEN status END, CASE WHEN status IN ('completed', 'failed') THEN row(updated_at, received_at, status) END), "
    "arg_max(status, row(updated_at, received_at, status, processed_files, coalesce(current_file, ''), coalesce(error, ''), coalesce(output_filename, '')))) AS status, max(total_files) AS total_files, max(processed_files) AS processed_files, "
    "CASE WHEN max(total_files) > 0 THEN CAST(round(max(processed_files) / max(total_files) * 100) AS INTEGER) END AS progress, max(record_count) AS record_count, max(output_filename) AS output_filename, max(error) AS error FROM task_status GROUP BY task_id"
)
register(
    "output_names",
    lambda spark, d: table(spark, d, "url_result").select(
        "task_id", "url", sinks.output_name(urls.split_extension(F.col("filename"))["stem"], F.col("source_type") == "http_pdf", F.col("finished_at")).alias("single"),
        sinks.batch_name(F.col("finished_at"), F.md5(F.col("task_id").cast("binary"))).alias("batch"), sinks.archive_name(F.col("task_id"), F.col("source_type") == "http_pdf", F.col("finished_at")).alias("archive"),
    ),
    r"SELECT task_id, url, CASE WHEN source_type = 'http_pdf' THEN 'reg_' ELSE '' END || CASE WHEN contains(filename, '.') THEN regexp_extract(filename, '(?s)^(.*)(\.[^.]*)$', 1) ELSE filename END || '_' || t || '.jsonl' AS single, "
    "'url_batch_' || t || '_' || substr(md5(task_id), 1, 8) || '.jsonl' AS batch, CASE WHEN source_type = 'http_pdf' THEN 'reg_' ELSE 'batch_' END || task_id || '_' || t || '.jsonl' AS archive "
    "FROM (SELECT *, strftime(finished_at, '%Y%m%d_%H%M%S') AS t FROM url_result)",
)
register("job_status", lambda spark, d: jobs.job_status(table(spark, d, "task_status")), _STATUS)
register("job_states", lambda spark, d: jobs.job_status(table(spark, d, "task_status")).groupBy("status").agg(F.count("*").alias("tasks")), f"SELECT status, count(*) AS tasks FROM ({_STATUS}) GROUP BY status")


def _lookup(spark, d):
    reports = table(spark, d, "task_status")
    return jobs.lookup(jobs.job_status(reports), reports.agg(F.min("task_id")).first()[0])


register("job_lookup", _lookup, f"SELECT * FROM ({_STATUS}) WHERE task_id = (SELECT min(task_id) FROM task_status)")


def _url_results(spark, d):
    sub = table(spark, d, "url_submission").select("task_id", "url").distinct()
    res = table(spark, d, "url_result").groupBy("task_id", "url").agg(F.max_by("status", F.struct("finished_at", "arrived_at", "status")).alias("status"), F.max("error").alias("error"))
    n = table(spark, d, "pretrain").filter("source_url <> ''").groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("n"))
    return jobs.url_results(sub, res, n, urls.url_error(F.col("url")))


register(
    "url_results", _url_results,
    f"WITH c AS (SELECT DISTINCT task_id, url, {urls.sql_url_error('url')} AS refused FROM url_submission), "
    "r AS (SELECT task_id, url, arg_max(status, row(finished_at, arrived_at, status)) AS status, max(error) AS error FROM url_result GROUP BY task_id, url), "
    "n AS (SELECT source_url AS url, count(*) AS n FROM pretrain WHERE source_url <> '' GROUP BY source_url) "
    "SELECT task_id, url, 'skipped' AS status, CAST(NULL AS BIGINT) AS record_count, refused AS error FROM c WHERE refused <> '' "
    "UNION ALL SELECT c.task_id, c.url, r.status, CASE WHEN r.status = 'success' THEN coalesce(n.n, 0) END, r.error FROM c JOIN r ON c.task_id = r.task_id AND c.url = r.url LEFT JOIN n ON c.url = n.url WHERE refused = ''",
)
_W = "greatest(1, least(greatest(1, p_size - 2), greatest(1, CAST(floor(p_retailprice / 100 / CAST(1.8 AS DOUBLE)) AS INTEGER))))"
_SERIAL = f"({_W} <= 1 OR p_size <= 2 OR p_retailprice / 100 < 4)"


_BATCH = "least(greatest(4, CAST(floor(greatest(p_retailprice * 16, 4096) / 2048) AS INTEGER)), 16)"


def _plan(spark, d):
    """Parts stand in for machines: size as cores, price as memory, every third with graphics cards."""
    gpus = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") % 4).otherwise(0)
    p = jobs.parallel_plan(F.col("p_size"), F.col("p_retailprice") / 100, gpus, F.col("p_retailprice") * 16)
    return table(spark, d, "part").select("p_partkey", *[p[c].alias(c) for c in ("workers", "batch", "serial")])


register(
    "parallel_plan", _plan,
    f"SELECT p_partkey, CASE WHEN g > 0 THEN least(g, 2) ELSE CAST(CASE WHEN {_SERIAL} THEN 1 ELSE least({_W}, 8) END AS INTEGER) END AS workers, "
    f"CASE WHEN g > 0 THEN {_BATCH} ELSE 1 END AS batch, CASE WHEN g > 0 THEN false ELSE {_SERIAL} END AS serial FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_size % 4 ELSE 0 END AS g FROM part)",
)
