"""Sentence boundaries across languages and scripts.

A document is cut by semi-Markov dynamic programming: among all ways to divide a paragraph into whole spans, the one
with the best sum of span scores is taken. A span's score looks jointly at its opening word, its closing word and mark,
its length, the line ends it runs across, and its quotations and brackets: a span that divides one is not allowed.

What opens and closes sentences is learned from the corpus itself: openings after marks that are certain (full stops and
question marks of scripts that use them for nothing else, ends of paragraphs), words before a dot that goes on in lower
case or in a number (abbreviations), and words in mid-sentence. These are counted over all documents, whole, in one pass:
each task adds up its own before the shuffle, and only what is supported (``SUPPORT`` times, and once in ``SHARE``
openings, which bounds the model whatever the number of documents) comes back. The segmentation is one more narrow pass.

Defined cases: null text gives no rows, nor does an empty or blank one; text without any mark is one sentence per
heading line; an unbalanced quotation mark is ignored beyond the paragraph; repeated rows give equal rows; line ends may
be LF, CR or CRLF; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Occurrences from which on a counted word is kept, and the share of all openings it must have: one in so many.
SUPPORT, SHARE = 2, 1_000_000
#: Openings at which what was never seen weighs half as much as it does in the end.
HALF = 100
#: Words that a task counts before it hands them on.
COUNTED = 200_000

OPEN = "“‘«「『（(【《〈[„‹〔"
CLOSE = "”’»」』）)】》〉]“›〕"
PAIR = {"“": "”", "‘": "’", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "《": "》", "〈": "〉", "[": "]", "„": "“", "‹": "›", "〔": "〕"}
BLANK = "\t\n\r  　"

_PARA = re.compile(r"(?:\r\n|\r|\n)[\t  　]*(?:(?:\r\n|\r|\n)[\t  　]*)+")
#: A candidate boundary: closing marks with the quotes behind them, a line end, or a gap in a script without marks.
_MARKS = (
    r"((?:[。！？!?।॥؟۔｡]|…+|\.{3,})+[”’»」』）)】》〉\]\"›“]*(?: »)?)"
    r"|([.．][”’»」』）)】》〉\]\"›“]*(?=[\s　]|$|[^\x00-\x7f]))"
    r"|((?:\r\n|\r|\n)[\t  　]*)"
)
_HIT = re.compile("[。！？!?।॥؟۔｡….．\n\r]")
_CAND = re.compile(_MARKS)
_CAND_GAP = re.compile(_MARKS + r"|( +(?=[฀-๿]))")
SURE, DOT, LINE, GAP = 1, 2, 3, 4
_QUOTES = re.compile(r"[“”‘’«»「」『』（）()【】《》〈〉\[\]„‹›〔〕\"]")
_WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
_LAST = re.compile(r"[^\s　“”‘’«»（）()「」『』\"，、；：,;:。！？!?…।]+$")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_THAI = re.compile("[฀-๿]")
#: What stands behind a comma or a gap, as ``open_key`` names it.
_INNER = re.compile(r"(?:[,，、；：;:] ?| (?=\S))[“‘«「『（(【《〈\[„‹〔\"]*(?:(\d)|([぀-ヿ㐀-鿿豈-﫿].?)|([฀-๿].{0,5})|([^\W\d_]+(?:[-’'][^\W\d_]+)*)|(\S))")
_MARK_END = re.compile(r"(?:[。！？!?।॥؟۔｡…]|\.)[”’»」』）)】》〉\]\"›“ ]*$")
_PLAIN_END = re.compile(r"[。！？!?।॥؟۔｡]\s*$")
_NUMBERING = re.compile(r"\s*(?:\[\d+\]|[（(]?[0-9一二三四五六七八九十]{1,3}[）)、．.]|\d+(?:\.\d+)+|第[0-9一二三四五六七八九十百]+[条章节款项])[\t  　]*")


def candidates(t: str, thai: bool):
    """Matches of the candidate pattern, found by their first sign."""
    if thai:
        yield from _CAND_GAP.finditer(t)
        return
    last = 0
    match = _CAND.match
    for h in _HIT.finditer(t):
        if h.start() >= last and (m := match(t, h.start())):
            last = m.end()
            yield m


def open_key(t: str, at: int, end: int) -> str:
    """What a span opens with: a word, two ideographs, six signs of a script without spaces, the kind of a number."""
    while at < end and t[at] in BLANK:
        at += 1
    if at == 0 or "\n" in t[max(0, at - 4) : at] or "\r" in t[max(0, at - 4) : at]:
        m = _NUMBERING.match(t, at, end)
        if m and m.end() < end:
            return "#"
    while at < end and t[at] in OPEN + '"':
        at += 1
        while at < end and t[at] in BLANK:
            at += 1
    if at >= end:
        return ""
    c = t[at]
    if c.isdigit():
        return "0"
    if _CJK.match(c):
        return t[at : at + 2]
    if _THAI.match(c):
        return t[at : at + 6]
    m = _WORD.match(t, at, min(end, at + 24))
    return m[0] if m else c


def close_key(t: str, start: int, at: int) -> str:
    m = _LAST.search(t, max(start, at - 24), at)
    if not m:
        return t[at - 1 : at]
    w = m[0]
    if _CJK.match(w[-1]) or _THAI.match(w[-1]):
        return w[-3:]
    return re.sub(r"\d+", "0", w)[-12:]


def enclosed(t: str) -> list[tuple[int, int]]:
    """Outermost balanced quotations and brackets (start, end exclusive); what never closes in the paragraph is ignored."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    for m in _QUOTES.finditer(t):
        c, i = m[0], m.start()
        if c == "’" and i + 1 < len(t) and t[i + 1].isalpha() and i and t[i - 1].isalpha():
            continue
        k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), None)
        if k is not None and not (c == "“" and PAIR["„"] != c):
            start = stack[k][1]
            del stack[k:]
            if not stack or k == 0:
                out.append((start, i + 1))
        elif c == '"':
            stack.append(('"', i))
        elif c in PAIR:
            stack.append((PAIR[c], i))
    out.sort()
    merged: list[tuple[int, int]] = []
    for s, e in out:
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


class Model:
    """Counts of openings and closings; picklable and small (bounded by ``SHARE``)."""

    KINDS = ("opens", "inner", "abbr", "dotted", "closes")

    def __init__(self):
        self.opens: Counter = Counter()
        self.inner: Counter = Counter()
        self.abbr: Counter = Counter()
        self.dotted: Counter = Counter()
        self.closes: Counter = Counter()
        self.starts = 1

    @property
    def known(self) -> float:
        """How much it means that something was never seen: from 0 for a model that saw nothing to 1."""
        return self.starts / (self.starts + HALF)

    def size(self) -> int:
        return sum(len(getattr(self, k)) for k in self.KINDS)

    def rows(self) -> list[tuple[str, str, int]]:
        out = [(k, w, n) for k in self.KINDS for w, n in getattr(self, k).items()]
        return [*out, ("starts", "", self.starts - 1)]

    def learn(self, text: str) -> None:
        for t in _PARA.split(text):
            inside = enclosed(t)
            starts = [s for s, _ in inside]
            for m in candidates(t, _THAI.search(t) is not None):
                kind = m.lastindex
                j = bisect_right(starts, m.start()) - 1
                depth = j >= 0 and m.start() < inside[j][1] - 1
                key = open_key(t, m.end(), len(t))
                if not key or depth:
                    continue
                if kind == SURE and m[0][-1] not in CLOSE + '"' and m.end() < len(t) and t[m.end()] not in "，、；：,;:）)":
                    if not ("…" in m[0] and key[0].islower()):
                        self.opens[key] += 1
                        self.starts += 1
                elif kind == LINE and _PLAIN_END.search(t[max(0, m.start() - 6) : m.start()]):
                    self.opens[key] += 1
                    self.starts += 1
                elif kind == LINE and _THAI.match(t, m.end()) and not layout(t)[0]:
                    self.opens[key] += 1
                    self.closes[close_key(t, 0, m.start())] += 1
                elif kind == DOT:
                    w = close_key(t, 0, m.start())
                    self.dotted[w] += 1
                    if key[0].islower() or key == "0" or key in ",;:":
                        self.abbr[w] += 1
            first = open_key(t, 0, len(t))
            if first:
                self.opens[first] += 1
                self.starts += 1
            self.inner.update(["0" if m.lastindex == 1 else m[m.lastindex] for m in _INNER.finditer(t)])
            self.closes[close_key(t, 0, len(t.rstrip(BLANK)))] += 1

    def opening(self, key: str) -> float:
        """Log odds that a span opens with the key."""
        if not key:
            return 0.0
        if key == "#":
            return 2.0
        n, k = self.opens[key], self.inner[key]
        s = math.log((n + 0.3) / (k + 1.0)) + 1.0
        c = key[0]
        if c.isalpha() and c.islower():
            return -6.0 + (2.0 if n > 20 * k + 20 else 0.0)
        if c in "，、；：,;:—–-)）":
            return -9.0
        if c.isupper():
            s = max(-2.0, min(s, 2.0)) + (0.8 if n else -0.6)
        return max(-4.0, min(s, 3.0))

    def abbreviation(self, word: str) -> float:
        """Share of dots behind the word that go on in the sentence, smoothed."""
        n = self.dotted[word]
        if len(word) == 1 and word.isalpha() and not _CJK.match(word):
            return 0.95
        if n == 0:
            return 0.25 if len(word) > 3 else 0.5
        return (self.abbr[word] + 0.1) / (n + 0.4)


def paragraphs(text: str):
    at = 0
    for m in _PARA.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def layout(text: str) -> tuple[bool, int]:
    """Whether the text's lines are wrapped, and the width they are wrapped to."""
    lines = [x.rstrip() for x in text.splitlines()]
    inner = [x for x, y in zip(lines, lines[1:]) if x and y]
    if len(inner) < 2:
        return False, 0
    open_ended = sum(not _MARK_END.search(x[-8:]) for x in inner)
    widths = sorted(map(len, inner))
    wide = widths[-1 - len(widths) // 20]
    return open_ended * 2 > len(inner) and wide <= 160 and widths[len(widths) // 2] >= 0.55 * wide, wide


def sentences(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in order, without blanks at either end."""
    out: list[tuple[int, int]] = []
    shape = layout(text)
    for s, e in paragraphs(text):
        while s < e and text[s] in BLANK:
            s += 1
        while e > s and text[e - 1] in BLANK:
            e -= 1
        if s < e:
            _paragraph(text[s:e], s, model, shape, out)
    return out


def _after_quote(t: str, m: re.Match, inside: list, starts: list) -> int | None:
    """End of the mark when it closes a quotation; None when it stands inside one; its own end otherwise."""
    a, b = m.span()
    j = bisect_right(starts, a) - 1
    if j >= 0 and a < inside[j][1]:
        stop = inside[j][1]
        return None if b < stop or m.lastindex >= LINE else stop
    return b


def _paragraph(t: str, base: int, model: Model, shape: tuple[bool, int], out: list) -> None:
    inside = enclosed(t)
    starts = [a for a, _ in inside]
    wrapped, wide = shape
    n = len(t)
    ends, nexts, gains, kinds = [], [0], [], []
    thai = _THAI.search(t) is not None
    for m in candidates(t, thai):
        kind = m.lastindex
        a = m.start()
        while kind == LINE and a and t[a - 1] in BLANK:
            a -= 1
        b = _after_quote(t, m, inside, starts) if inside else m.end()
        if b is None:
            continue
        nxt = b
        while nxt < n and t[nxt] in BLANK:
            nxt += 1
        if nxt >= n:
            break
        c = t[nxt]
        if c in "，、；：,;:）)」』”»—–…。！？":
            continue
        lower = c.islower()
        if kind == SURE:
            quoted = t[b - 1] in CLOSE or t[b - 1] == '"'
            newline = "\n" in t[b:nxt] or "\r" in t[b:nxt]
            if not quoted:
                score = 9.0 if not lower else -2.0 if newline or "…" in m[0] else 1.0
            else:
                key = open_key(t, nxt, n)
                score = model.opening(key) + 1.0 + (1.0 if newline and not wrapped else 0.0)
                if _CJK.match(c) and model.opens[key] == 0 and not newline:
                    score -= 3.0 * model.known
        elif kind == DOT:
            if "ऀ" <= t[a - 1 : a] <= "ॿ":
                continue
            if thai and _THAI.match(t, max(0, a - 1)):
                score = _gap(t, a, open_key(t, nxt, n), model)
            elif _LINE_START_NUMBER.search(t, max(0, a - 8), a + 1) and ("\n" in t[max(0, a - 8) : a] or a < 8):
                continue
            else:
                key = open_key(t, nxt, n)
                w = close_key(t, 0, a)
                p = model.abbreviation(w)
                score = model.opening(key)
                if key != "#" and _SHORT_NUMBER.search(t, max(0, a - 4), a):
                    score -= 1.0  # an ordinal: only what follows can tell
                else:
                    score = (score if lower else max(score, -2.0)) + 12.0 * (0.5 - p)
        elif kind == LINE:
            if _MARK_END.search(t, max(0, a - 8), a):
                continue  # the mark before it is the candidate
            if lower or t[a - 1] in "，、；：,;:-—–":
                continue
            key = open_key(t, nxt, n)
            score = model.opening(key) + 0.5 - (2.5 * model.known if not model.opens[key] and key != "#" else 0.0)
            if wrapped:
                own = a - (t.rfind("\n", 0, a) + 1)
                first = 1 if _CJK.match(c) else _token(t, nxt)
                score += 2.0 if own + 1 + first < wide else -5.0
            else:
                score += 2.5 + (0.5 if model.closes[close_key(t, 0, a)] else -1.5)
        else:
            score = _gap(t, a, open_key(t, nxt, n), model)
        ends.append(a if kind >= LINE else b)
        nexts.append(nxt)
        gains.append(score)
        kinds.append(kind)
    ends.append(n)
    gains.append(0.0)
    kinds.append(SURE)
    # best[i]: score of the best division that has a boundary at candidate i - 1
    best = [0.0] * (len(ends) + 1)
    back = [0] * (len(ends) + 1)
    high = [0.0] * (len(ends) + 1)  # the best score up to a candidate
    for j in range(1, len(ends) + 1):
        top, arg, end, line = -1e18, j - 1, ends[j - 1], kinds[j - 1] == LINE
        for i in range(j - 1, -1, -1):
            at = nexts[i]
            length = end - at
            v = best[i] + (-2.0 if length < 3 else 0.0) - (0.002 * (length - 400) if length > 400 else 0.0)
            if line and at and t[at - 1] not in "\n\r\t 　" or line and at and "\n" not in t[ends[i - 1] : at]:
                v -= 7.0  # a heading fills its line from the start
            if v > top:
                top, arg = v, i
            if i and high[i - 1] - (0.002 * (length - 400) if length > 400 else 0.0) <= top:
                break  # a start further back can at most reach the best score there, less what the length costs
            if i and gains[i - 1] >= 8.0:
                break  # nothing is gained by running across a certain boundary
        best[j] = top + gains[j - 1]
        back[j] = arg
        high[j] = max(high[j - 1], best[j])
    spans, j = [], len(ends)
    while j > 0:
        i = back[j]
        a, b = nexts[i], ends[j - 1]
        while b > a and t[b - 1] in BLANK:
            b -= 1
        if b > a:
            spans.append((base + a, base + b))
        j = i
    out.extend(reversed(spans))


def _token(t: str, at: int) -> int:
    k = at
    while k < len(t) and k - at < 40 and t[k] not in BLANK:
        k += 1
    return k - at


def _gap(t: str, a: int, key: str, model: Model) -> float:
    """Score of a gap in a script that closes no sentence: both the words around it must be known at such places."""
    left = close_key(t, 0, a)
    o = model.opens[key]
    return (1.5 if o >= 2 and o * 12 >= model.inner[key] else -3.0) + (0.5 if model.closes[left] else -3.0)


_SHORT_NUMBER = re.compile(r"(?:^|[^\d.,A-Za-z])\d{1,2}$")
_LINE_START_NUMBER = re.compile(r"(?:^|[\r\n])[\t  　]*\d{1,3}(?:\.\d{1,3})*[.．]$")


def fit(df: DataFrame, text_col: str = "text") -> Model:
    """Counts over all texts of ``df``, whole."""

    def count(batches):
        m = Model()

        def out():
            rows = m.rows()
            return pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], pa.string()) for c in (0, 1)), pa.array([r[2] for r in rows], pa.int64())], names=["kind", "key", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    m.learn(t)
                if m.size() > COUNTED:
                    yield out()
                    m = Model()
        yield out()

    rows = df.select(text_col).mapInArrow(count, "kind string, key string, n bigint")
    counted = cut(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= SUPPORT))
    model = Model()
    starts = counted.filter("kind = 'starts'").agg(F.sum("n")).first()[0]
    model.starts += starts or 0
    for r in counted.filter((F.col("kind") != "starts") & (F.col("n") >= model.starts / SHARE)).toLocalIterator():
        getattr(model, r["kind"])[r["key"]] = r["n"]
    return model


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos): one row per sentence, end exclusive, positions in code points."""
    model = model or fit(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            ids, s, e = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and i is not None:
                    for x, y in sentences(t, m):
                        ids.append(i)
                        s.append(x)
                        e.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, s, e)], names=["doc_id", "start_pos", "end_pos"])

    return df.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, "doc_id bigint, start_pos bigint, end_pos bigint")
