import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import quality, urls
from corpusloom.operators import html, regulation, segment
from corpusloom.plans import api, jobs
from corpusloom.settings import Settings
from corpusloom.sources import files, http, sinks, url_lists


@pytest.mark.parametrize(
    "text,there,gone",
    [
        ("第一条\n甲级\n内容很长的一个句子。", ["第一条"], ["甲级"]),
        ("【全文】通知内容如下文所述", ["通知内容"], ["全文"]),
        ("Fin.\n正文内容继续说明。", ["正文"], ["Fin."]),
        ("一、总则\n12\n13800000000\n序号\n说明文字在此处。", ["一、总则"], ["12", "13800000000", "序号"]),
        ("￾ﾃ正常文字一行\nÃ¤Â¸Â­Ã¥ÂÂÃ¤Â¸Â­\n结尾的一行文字", ["结尾的一行文字"], ["Ã¤"]),
        ("a​b﻿c 一段正常的说明文字", ["abc"], ["​"]),
    ],
)
def test_regulation_clean(column, text, there, gone):
    (out,) = column(regulation.clean, text)
    assert all(x in out for x in there) and not any(x in out for x in gone), out


def test_regulation_sections(column):
    a, b = "一、" + "甲" * 130, "二、" + "乙" * 130
    assert column(lambda c: segment.segment_regulation(c), f"{a}\n{b}")[0] == [a, b]


def test_mojibake(column):
    assert column(quality.is_mojibake, "ÈÈÁ¦¹ÜÏß", "正常的中文文字", "abc", "─│─│正常文字内容") == [True, False, False, True]


URLS = [
    ("", False), (None, False), ("ftp://a.example/x", False), ("http://", False), ("http://LOCALHOST/x", False), ("https://10.1.2.3/x", False), ("http://172.20.0.1", False),
    ("http://172.32.0.1", True), ("http://[::1]/", False), (" https://a_b.example:8080/p?q=1#f ", True), ("http://user@a.example/x y", True),
]


def test_validate(column):
    assert [x["is_valid"] for x in column(urls.validate_url, *[u for u, _ in URLS])] == [ok for _, ok in URLS]


def test_filename(column):
    got = column(lambda c: urls.derive_filename(c, F.lit("application/pdf")), "http://a.example/b/c.pdf", "http://a.example/b/c", "http://a.example/", "http://a.example/x/q:1.doc")
    assert got[0] == "c.pdf" and got[1].startswith("a.example_") and got[1].endswith(".pdf") and got[2].startswith("a.example_") and got[3] == "q_1.doc.pdf"
    (long,) = column(lambda c: urls.derive_filename(c, F.lit("")), "http://a.example/" + "x" * 300 + ".html")
    assert len(long) == 200 and long.endswith(".html")


def test_dedupe(spark):
    rows = [(0, "http://A.example/x/"), (1, "HTTP://a.example:80/x#f"), (2, "http://a.example/X"), (3, " "), (4, "http://a.example/x?q=1"), (5, "http://a.example/x")]
    got = urls.deduplicate_urls(spark.createDataFrame(rows, "pos int, url string")).orderBy("pos").collect()
    assert [r.pos for r in got] == [0, 2, 4]


def test_url_lists(column):
    assert column(url_lists.parse_text, "# c\nsee http://a.example/x).\n\nhttpfoo\nnothing")[0] == ["http://a.example/x", "httpfoo"]
    assert column(url_lists.parse_csv, 'url,n\n"http://a.example/x,y",1\nhttp://b.example,2\nfoo')[0] == ["http://a.example/x,y", "http://b.example"]
    assert column(url_lists.parse_json, '["http://a", {"link": "http://b"}, {"x": 1}]', '{"a": ["http://c", "d"], "b": "http://e"}', "3") == [["http://a", "http://b"], ["http://c", "http://e"], None]


def test_html():
    page = "<html><head><title>t</title></head><body><nav>m</nav><p>一<b>二</b></p><div style='display:none'><p>h</p></div><p aria-hidden='true'>g</p><script>x<y</script>A &amp; B</body></html>"
    assert html.html_text(page) == "一\n二\nA & B"
    assert html.decode("<p>中文内容在此处</p>".encode("gbk")) == "<p>中文内容在此处</p>"
    assert html.decode("<p>中文内容在此处</p>".encode()) == "<p>中文内容在此处</p>"
    assert html.detect_encoding(b"<meta charset=gbk>") == "gbk" and html.detect_encoding(b"x", "text/html; charset=ISO-8859-1") == "iso8859-1"


def test_zip_and_extract(spark, tmp_path):
    b = BytesIO()
    body = "<p>" + "根据质疑答复的要求，应当保存检测记录不少于十二个月。" * 8 + "</p>"
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("d/", "")
        z.writestr("a.HTML", body)
        z.writestr("n.txt", "x")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.zip").write_bytes(b.getvalue())
    (tmp_path / "in/bad.zip").write_bytes(b"nope")
    (tmp_path / "in/p.html").write_text(body)
    (tmp_path / "in/e.html").write_bytes(b"")
    (tmp_path / "in/q.doc").write_bytes(b"q")
    found = {r.file_name: r.reason for r in files.scan(spark, str(tmp_path / "in")).collect()}
    found.pop("e.html", None)  # the source lists no files without bytes
    assert found == {"x.zip": None, "bad.zip": None, "p.html": None, "q.doc": "extension"}
    rows = files.unzip(files.scan(spark, str(tmp_path / "in")).filter("ext = 'zip'")).collect()
    assert sorted((r.zip_name, r.entry_name, r.error is None) for r in rows) == [("bad.zip", None, False), ("x.zip", "a.HTML", True)] or len(rows) == 2
    out = api.extract_files(spark, str(tmp_path / "in"), "regulation")
    assert sorted({(r.file_name, r.source) for r in out.collect()}) == [("p.html", "local_html"), ("x.zip/a.HTML", "zip_html")]
    sinks.write_jsonl(out, str(tmp_path / "out"), single=True)
    assert spark.read.json(str(tmp_path / "out")).count() == out.count() and len(list((tmp_path / "out").glob("*.json"))) == 1
    with pytest.raises(api.Refused):
        api.extract_files(spark, str(tmp_path), "novel")
    with pytest.raises(PermissionError):
        sinks.resolve_output(str(tmp_path / "out"), "../in/x.zip")


def test_fetch(spark):
    def web(url, settings):
        if "slow" in url:
            raise TimeoutError("slow")
        if "img" in url:
            return b"x", "image/png", url
        return ("<p>" + "应当保存检测记录不少于十二个月，并报送主管部门备案。" * 8 + "</p>").encode(), "text/html; charset=utf-8", url

    urls_df = spark.createDataFrame([(0, "http://a.example/x"), (1, "http://slow.example/"), (2, "http://img.example/i"), (3, "http://localhost/"), (4, "http://a.example/x#2")], "pos int, url string")
    records, results = api.extract_urls(urls_df, web, "regulation", settings=Settings(retries=0))
    assert {r.url: r.status for r in results.collect()} == {"http://a.example/x": "success", "http://slow.example/": "failed", "http://img.example/i": "failed", "http://localhost/": "skipped"}
    assert records.count() >= 1


@pytest.fixture
def web(tmp_path):
    """A local server with pages, files, redirects and faults."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked = []

    class Web(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.answer(False)

        def do_GET(self):
            self.answer(True)

        def log_message(self, *a):
            pass

        def answer(self, body):
            asked.append((self.command, self.path, self.headers.get("User-Agent")))
            p = self.path
            if p.startswith("/hop"):
                n = int(p[4:])
                self.send_response(302)
                self.send_header("Location", f"/hop{n - 1}" if n else "/page")
                self.end_headers()
                return
            if p == "/gone":
                self.send_error(404)
                return
            kind, data = {"/page": ("text/html; charset=utf-8", ("<p>" + "应当保存检测记录不少于十二个月，并报送主管部门备案。" * 8 + "</p>").encode()), "/blank": ("text/html", b"<nav>menu</nav>"),
                          "/doc.pdf": ("application/pdf", b"a|b"), "/img": ("image/png", b"x"), "/big": ("text/html", b"x" * 5000), "/short": ("text/html", b"<p>kurz</p>")}[p]
            self.send_response(200)
            self.send_header("Content-Type", kind)
            if p != "/big" or not body:
                self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if body:
                self.wfile.write(data)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Web)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_client(web):
    base, asked = web
    s = Settings(max_url_bytes=1000, max_redirects=2, user_agent="agent/7", read_timeout_s=5)
    body, ct, final = http.download(base + "/hop1", s)
    assert b"\xe5" in body and ct.startswith("text/html") and final == base + "/page" and asked[0][2] == "agent/7"
    with pytest.raises(ValueError, match="redirects"):
        http.download(base + "/hop5", s)
    with pytest.raises(ValueError, match="HTTP 404"):
        http.download(base + "/gone", s)
    with pytest.raises(ValueError, match="Content-Length 5000 exceeds max allowed size 1000 bytes"):
        http.download(base + "/big", s)
    assert ("GET", "/big") not in {x[:2] for x in asked}
    with pytest.raises(ConnectionError):
        http.download("http://127.0.0.1:9/", Settings(connect_timeout_s=2))
    with pytest.raises(ValueError, match="scheme"):
        http.download("ftp://127.0.0.1/", s)


def _at(base):
    """Fetches hosts of addresses that are allowed from the local server."""
    return lambda url, s: http.download(base + "/" + url.split("/", 3)[3], s)


def test_fetched_failures(spark, web):
    base, _ = web
    paths = ("page", "blank", "img", "gone", "doc.pdf", "big")
    asked = spark.createDataFrame([(i, f"http://a.example/{p}") for i, p in enumerate(paths)] + [(9, "http://localhost/x")], "pos int, url string")
    s = Settings(max_url_bytes=1000, retries=0)
    rows = {r.url.rsplit("/", 1)[1]: r for r in files.fetch(asked, _at(base), s).collect()}
    assert rows["page"].success and rows["page"].content is None and rows["page"].text.startswith("应当")
    assert rows["doc.pdf"].success and bytes(rows["doc.pdf"].content) == b"a|b" and rows["doc.pdf"].filename == "doc.pdf"
    assert {k: r.error for k, r in rows.items() if not r.success} == {
        "blank": "HTML page contains no extractable text.", "img": "Unsupported content type 'image/png'. Only PDF and HTML are accepted.", "gone": "HTTP 404: Not Found",
        "big": "Content-Length 5000 exceeds max allowed size 1000 bytes. Refusing to download.", "x": "URL validation failed: Internal hostname 'localhost' is not allowed.",
    }
    skipped = files.fetch(asked.filter("pos = 0"), _at(base), Settings(html_mode="skip")).collect()[0]
    assert not skipped.success and skipped.error == "HTML extraction is disabled (html_extraction_mode=skip)."


def test_retries():
    from pyspark.sql import SparkSession

    def down(url, s):
        raise TimeoutError("slow")

    spark = SparkSession.getActiveSession()
    row = files.fetch(spark.createDataFrame([("http://a.example/",)], "url string"), down, Settings(retries=2), sleep=lambda x: None).collect()[0]
    assert row.error == "Failed to download http://a.example/ after 3 attempts. Last error: slow" and row.filename is None


def test_single_address(spark, web, tmp_path):
    base, _ = web
    s = Settings(output_dir=str(tmp_path), retries=0)
    got = api.extract_url(spark, "http://a.example/page", "regulation", _at(base), settings=s)
    assert got.record_count >= 1 and got.source == "http_html" and got.source_url == "http://a.example/page" and got.preview[0]["category"] == "法规文本"
    assert spark.read.json(str(api.read_output(got.filename, s))).count() == got.record_count
    for path, why in (("blank", "HTML page contains no extractable text."), ("gone", "HTTP 404"), ("short", "no usable content")):
        with pytest.raises(api.Refused, match=why):
            api.extract_url(spark, f"http://a.example/{path}", "regulation", _at(base), settings=s)
    with pytest.raises(api.Refused, match="Internal hostname"):
        api.extract_url(spark, "http://localhost/x", settings=s)
    pdf = api.extract_url(spark, "http://a.example/doc.pdf", "regulation", _at(base), lambda c, dpi: [c], lambda: lambda page: "应当保存检测记录不少于十二个月，并报送主管部门备案。" * 8, s)
    assert pdf.source == "http_pdf" and pdf.filename.startswith("doc_")
    with pytest.raises(api.Refused) as e:
        api.read_output("none.jsonl", s)
    assert e.value.status == 404


def test_single_file_and_archive(spark, tmp_path):
    body = "<p>" + "根据质疑答复的要求，应当保存检测记录不少于十二个月。" * 8 + "</p>"
    s = Settings(output_dir=str(tmp_path / "out"))
    for d in ("a", "b", "z", "bad"):
        (tmp_path / d).mkdir()
    (tmp_path / "a/p.html").write_text(body)
    (tmp_path / "b/p.html").write_text("<nav>x</nav>")
    (tmp_path / "bad/x.zip").write_bytes(b"nope")
    with zipfile.ZipFile(tmp_path / "z/x.zip", "w") as z:
        z.writestr("one.html", body)
        z.writestr("two.html", "<nav>x</nav>")
        z.writestr("three.pdf", "x")
    got = api.extract_file(spark, str(tmp_path / "a/p.html"), "regulation", settings=s)
    assert got.filename.startswith("reg_p_") and got.source == "local_html" and got.record_count >= 1
    with pytest.raises(api.Refused, match="no extractable text"):
        api.extract_file(spark, str(tmp_path / "b/p.html"), "regulation", settings=s)
    done, results = api.extract_archive(spark, str(tmp_path / "z/x.zip"), "patent", settings=s)
    assert done.filename.startswith("batch_x_") and done.record_count >= 1
    assert {r.file_name: r.status for r in results.collect()} == {"x.zip/one.html": "success", "x.zip/two.html": "failed", "x.zip/three.pdf": "failed"}
    with pytest.raises(api.Refused, match="Invalid ZIP"):
        api.extract_archive(spark, str(tmp_path / "bad/x.zip"), settings=s)


def test_status_lookup(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    reports = spark.createDataFrame([("a", "completed", 2, 2, "f", 3, "o", None, t, t)], "task_id string, status string, total_files int, processed_files int, current_file string, record_count int, output_filename string, error string, updated_at timestamp, received_at timestamp")
    assert api.task_status(reports, "a")["progress"] == 100
    with pytest.raises(api.Refused) as e:
        api.task_status(reports, "b")
    assert e.value.status == 404


# One literal case per stage: text, what it becomes.
STAGES = {
    "bracket_line": ("甲\n【附件】 \n【一】乙", "甲\n\n【一】乙"),
    "bracket": ("甲【附件】乙【】", "甲乙"),
    "table_border": ("|--=＋", "|--=＋"),
    "box_drawing": ("┌─┐甲│", "甲"),
    "filler_line": ("□▲。\n□▲甲", "\n□▲甲"),
    "single_sign": (" 京 ", ""),
    "check_box": ("□□\n□甲", "\n□甲"),
    "short_digits": ("07\n123", "\n123"),
    "phone": ("13800138000\n138001", "\n138001"),
    "grade": ("甲级\n甲级企业", "\n甲级企业"),
    "column_label": ("联系人\n联系人：", "\n联系人："),
    "serial": ("2020-123456AB\n2020-12", "\n2020-12"),
}


@pytest.mark.parametrize("stage", regulation.STAGES, ids=lambda s: s[0])
def test_regulation_stage(column, stage):
    text, want = STAGES[stage[0]]
    assert column(lambda c: regulation.apply_stage(c, stage), text)[0] == want


def test_regulation_lines(column):
    assert column(regulation.strip_invisible, "\ufeff甲\u200b\u00a0乙\r丙\x07")[0] == "甲 乙\n丙"
    assert column(regulation.drop_garbled_lines, "æåå¤§å­¦ç\n甲乙\ncafé", "甲\n乙") == ["甲乙\ncafé", "甲\n乙"]
    assert column(regulation.drop_short_lines, "ab\n（三）\n第二条\n甲乙丙\n甲乙\n\nabcdef", None) == ["（三）\n第二条\n甲乙丙\n\nabcdef", None]


def test_ocr(spark):
    t = "array<array<struct<box:array<array<double>>,rec:struct<text:string,conf:double>>>>"
    rows = [("f", 2, [[{"box": None, "rec": {"text": " b ", "conf": 1.0}}, {"box": None, "rec": {"text": "", "conf": 1.0}}], None]), ("f", 1, [[{"box": None, "rec": {"text": "a", "conf": 1.0}}]]), ("f", 3, None)]
    pages = spark.createDataFrame(rows, f"file_name string, page_no int, regions {t}").select("file_name", "page_no", files.flatten_recognised(F.col("regions")).alias("t"))
    assert files.join_pages(pages, "file_name", "page_no", "t").collect()[0].raw_text == "a\n\f\nb"

    def make():
        return lambda page: page.decode().upper()

    got = files.recognise(spark.createDataFrame([("p", b"a|b")], "file_name string, content binary"), lambda c, dpi: c.split(b"|"), make)
    assert sorted((r.page_no, r.text) for r in got.collect()) == [(0, "A"), (1, "B")]


def test_parallel_plan(spark):
    rows = spark.createDataFrame([(1, 16.0, 0, 0), (8, 16.0, 0, 0), (32, 64.0, 0, 0), (8, 3.0, 0, 0), (4, 8.0, 3, 24000)], "c int, r double, g int, v int")
    got = [tuple(x.p) for x in rows.select(jobs.parallel_plan(F.col("c"), F.col("r"), F.col("g"), F.col("v")).alias("p")).collect()]
    assert got == [(1, 1, True), (6, 1, False), (8, 1, False), (1, 1, True), (2, 11, False)]


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("CORPUSLOOM_MIN_LENGTH", "7")
    assert Settings.load(spark).min_length == 7 and Settings.load(spark, min_length=9).min_length == 9
