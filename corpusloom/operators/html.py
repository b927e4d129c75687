"""HTML to text: encoding detection, removal of tags that carry no content, body text, blanks."""

from __future__ import annotations

import codecs
import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that are removed with their content; elements without an end tag.
REMOVED = ("script", "style", "noscript", "iframe", "svg", "nav", "footer", "header", "aside")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_BYTES = 4096
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
_META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([a-zA-Z0-9_\-]+)""", re.I)
_PAIR = re.compile(rb"[\x81-\xfe](?=[\x40-\xfe])")


def detect_encoding(html: bytes, content_type: str = "") -> str:
    """Charset of the header if its codec exists, else of a meta tag at the start, else by byte pairs, else UTF-8."""
    m = re.search(r"charset\s*=\s*[\"']?([\w\-]+)", content_type or "", re.I)
    if m:
        try:
            return codecs.lookup(m[1]).name
        except LookupError:
            pass
    head = html[:HEAD_BYTES]
    m = _META.search(head)
    if m:
        try:
            return codecs.lookup(m[1].decode("ascii")).name
        except LookupError:
            pass
    return "gb18030" if len(_PAIR.findall(head)) > 4 else "utf-8"


def decode(html: bytes, content_type: str = "") -> str:
    """Text of a page; a guessed encoding yields to UTF-8 when the bytes are valid UTF-8."""
    name = detect_encoding(html, content_type)
    if name == "gb18030":
        try:
            return html.decode("utf-8")
        except UnicodeDecodeError:
            pass
    return html.decode(name, "replace")


class _Text(HTMLParser):
    """Text nodes of the body, outside removed and hidden elements; unclosed inner elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.body: list[str] = []
        self.all: list[str] = []
        self.in_body = self.seen_body = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        off = tag in REMOVED or bool(_HIDDEN_STYLE.search(a.get("style") or "")) or a.get("aria-hidden") == "true"
        if tag == "body":
            self.in_body = self.seen_body = True
        if tag not in VOID:
            self.stack.append((tag, off or (bool(self.stack) and self.stack[-1][1])))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break
        if tag == "body":
            self.in_body = False

    def handle_data(self, data):
        if self.stack and self.stack[-1][1]:
            return
        s = data.strip()
        if s:
            self.all.append(s)
            if self.in_body:
                self.body.append(s)


def html_text(html: str) -> str:
    p = _Text()
    p.feed(html)
    p.close()
    s = "\n".join(p.body if p.seen_body else p.all)
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", s)).strip()


def extract(content: Column, content_type: Column) -> Column:
    """Body text of HTML bytes; null bytes, and bytes no parser can read, give null. Nesting and encodings need a parser, so it
    runs in Arrow batches."""

    def one(b, ct):
        try:
            return None if b is None else html_text(decode(bytes(b), ct or ""))
        except Exception:  # one page must not fail the others
            return None

    @F.pandas_udf("string")
    def run(c, t):
        return c.__class__([one(b, ct) for b, ct in zip(c, t)], dtype=object)

    return run(content, content_type)
