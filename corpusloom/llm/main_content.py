"""Page boilerplate mixed with main content.

A page's text is read as a tree: the page, its blocks (maximal runs of paragraphs or of short lines), its lines. Gradient-
boosted trees score every line from node features: density of the line and of its block, attribute tokens (log odds of
character pairs, bullets, separators, closing marks), depth (indent, list level, place in block and page) and sibling
statistics (the same for the neighbours, share of alike siblings). Decoding goes down the tree: a block is taken whole as
furniture or as content when its lines say so together, and only an undecided block is decided line by line, so that no
line contradicts its block.

Labels come from the corpus. Scans and downloads of other kinds carry articles without page furniture: a line shape (its
tokens with digits levelled) that web pages repeat and other sources never show is furniture; a shape that other sources
show, or a long line that closes a sentence, is content. Shapes are counted over all rows, partially aggregated before
the shuffle; the trees are fitted on the labelled lines of at most ``FIT_PAGES`` pages, those with the least id hash.

Defined cases: null text gives no lines; blank lines are never reported; a page of one line is scored like any other; a
table without web pages gives no rows; a table in which no labels can be had falls back to long lines as content and all
lines before the first and after the last of them as furniture; other sources pass through ``main_text`` unchanged, as do
other columns; repeated rows give equal rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import codes
from corpusloom.llm.gbt import BoostedTrees
from corpusloom.session import cut, hash_sample

WEB = ("http_html", "local_html")
#: Pages whose labelled lines the trees are fitted on.
FIT_PAGES = 4000
#: A shape is furniture when this many web lines show it and no other source does.
MIN_REPEAT = 5
LONG = 60

PAIRS = 1 << 16
_STOPS = "。！？!?；;…।.”）)」"
_SEPARATORS = "|·/-»>：:—→\t　_＞›"
_BULLETS = "·▪>»•◆■-*●○›＞→"


def line_shape(line: Column) -> Column:
    """Trimmed line with every token that has a digit levelled."""
    return F.regexp_replace(F.regexp_replace(line, "[A-Za-z]*[-‐‑]?[0-9０-９][A-Za-z0-9０-９./:-]*", "0"), "[\\s\\u00a0\\u3000]+", "")


def shape_labels(df: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """(shape, furniture): hash of a short line's shape and whether the corpus shows it to be furniture (1) or content (0)."""
    web = F.col(source_col).isin(*WEB)
    lines = df.filter(F.col(source_col).isNotNull()).select(web.alias("web"), F.explode(F.array_distinct(F.split(text_col, "\n", -1))).alias("line"))
    lines = lines.filter(F.length("line") <= LONG).select("web", F.xxhash64(line_shape(F.col("line"))).alias("shape"))
    n = lines.groupBy("shape").agg(F.count_if("web").alias("web"), F.count_if(~F.col("web")).alias("other"))
    label = F.when((F.col("other") == 0) & (F.col("web") >= MIN_REPEAT), 1).when(F.col("other") > 0, 0)
    return n.select("shape", label.alias("furniture")).filter("furniture is not null")


_CLASS = None


def _classes() -> np.ndarray:
    """Class of a code point: 1 digit, 2 Latin, 3 ideograph, 4 sentence mark, 5 separator, 6 blank, 7 other punctuation."""
    global _CLASS
    if _CLASS is None:
        c = np.full(0x110000, 7, np.uint8)
        c[0x30:0x3A] = 1
        c[0xFF10:0xFF1A] = 1
        for lo, hi in ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250)):
            c[lo:hi] = 2
        c[0x3400:0xA000] = 3
        for x in _STOPS:
            c[ord(x)] = 4
        for x in _SEPARATORS:
            c[ord(x)] = 5
        c[[0x20, 0xA0]] = 6
        _CLASS = c
    return _CLASS


def _pairs(a: np.ndarray) -> np.ndarray:
    """Bucket of each character pair; digits level."""
    a = np.where(_classes()[a] == 1, 0x30, a).astype(np.uint64)
    return ((a[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(np.int64) & (PAIRS - 1)


class Lines:
    """The lines of a batch of pages as arrays; one entry per line that isn't blank."""

    def __init__(self, texts: list[str | None]):
        page, number, kept = [], [], []
        for p, t in enumerate(texts):
            for k, line in enumerate((t or "").split("\n")):
                if line and not line.isspace():
                    page.append(p)
                    number.append(k)
                    kept.append(line)
        self.page, self.number, self.lines = np.array(page, np.int64), np.array(number, np.int64), kept

    def features(self, odds: np.ndarray) -> np.ndarray:
        n = len(self.lines)
        lens = np.array([len(x) for x in self.lines])
        a = codes("\n".join(self.lines) + "\n")
        starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
        cls = _classes()[a]
        cls[starts + lens] = 0
        score = odds[_pairs(a)] if len(a) > 1 else np.zeros(0, np.float32)
        score = np.append(score, np.float32(0))
        total = np.add.reduceat(score, starts)
        low, high = np.minimum.reduceat(score, starts), np.maximum.reduceat(score, starts)
        count = {c: np.add.reduceat((cls == c).astype(np.int32), starts) for c in range(1, 8)}
        mean = total / (lens + 1)
        stops = count[4]
        blanks = np.isin(a, [0x20, 0x3000, 0x9, 0xA0])
        # first and last sign that shows
        stripped = [x.strip() for x in self.lines]
        last = np.array([x[-1] in _STOPS for x in stripped], np.float32)
        bullet = np.array([x[0] in _BULLETS for x in stripped], np.float32)
        indent = np.array([len(x) - len(x.lstrip()) for x in self.lines], np.float32)
        tail = np.array([len(x) - len(x.rstrip()) for x in self.lines], np.float32)
        para = ((lens >= 40) & (stops > 0) & (last > 0)).astype(np.float32)
        # blocks: runs of paragraphs or of short lines within a page
        change = np.ones(n, bool)
        change[1:] = (self.page[1:] != self.page[:-1]) | (para[1:] != para[:-1])
        self.block = np.cumsum(change) - 1
        bstart = np.flatnonzero(change)
        bsize = np.diff(np.append(bstart, n))
        place = np.arange(n) - bstart[self.block]
        b_len = np.add.reduceat(lens, bstart) / bsize
        b_mean = np.add.reduceat(mean, bstart) / bsize
        pchange = np.ones(n, bool)
        pchange[1:] = self.page[1:] != self.page[:-1]
        pid = np.cumsum(pchange) - 1
        pstart = np.flatnonzero(pchange)
        psize = np.diff(np.append(pstart, n))
        top = np.arange(n) - pstart[pid]
        bottom = psize[pid] - 1 - top
        cum = np.cumsum(para)
        before = cum - para - (cum - para)[pstart][pid]
        paras = np.add.reduceat(para, pstart)[pid]

        def near(x, d, fill):
            y = np.full(n, fill, np.float32)
            if d > 0:
                y[d:] = np.where(self.page[d:] == self.page[:-d], x[:-d], fill)
            else:
                y[:d] = np.where(self.page[:d] == self.page[-d:], x[-d:], fill)
            return y

        size = np.log1p(lens)
        cols = [
            size, mean, total, low, high, *(count[c] / lens for c in range(1, 8)), stops, last, bullet, indent, tail, para,
            np.add.reduceat(blanks.astype(np.int32), starts) / lens, top, bottom, top / psize[pid], before, paras - before - para, paras,
            place, bsize[self.block], np.log1p(b_len)[self.block], b_mean[self.block],
        ]
        for d in (1, -1, 2, -2):
            cols += [near(size, d, 0), near(mean, d, 0), near(para, d, -1), near(bullet, d, -1)]
        return np.stack([np.asarray(c, np.float32) for c in cols], 1)


def decode(log_odds: np.ndarray, block: np.ndarray, mixed_cost: float = 1.0) -> np.ndarray:
    """Furniture flags: per block the best of all furniture, all content, or line by line at a cost."""
    if not len(log_odds):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    z = np.clip(log_odds, -12, 12)
    lf, lc = -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))
    f, c, m = (np.add.reduceat(x, first) for x in (lf, lc, np.maximum(lf, lc)))
    k = np.cumsum(np.append(True, block[1:] != block[:-1])) - 1
    m = m - mixed_cost
    whole = np.where(f >= c, 1, 0)
    best = np.maximum(f, c)
    return np.where(m[k] > best[k], z > 0, whole[k] == 1)


class Model:
    def __init__(self, odds: np.ndarray, trees: BoostedTrees | None):
        self.odds, self.trees = odds, trees

    def furniture(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(page index, line number) of every furniture line."""
        lines = Lines(texts)
        if not len(lines.lines):
            return lines.page, lines.number
        x = lines.features(self.odds)
        if self.trees is None:
            flags = (x[:, 17] == 0) & ((x[:, 23] == 0) | (x[:, 24] == 0))
        else:
            flags = decode(self.trees.predict(x), lines.block)
        return lines.page[flags], lines.number[flags]


def fit(df: DataFrame, id_col: str = "record_id", text_col: str = "text", source_col: str = "source", pages: int = FIT_PAGES) -> Model:
    """Model from the table's own labels."""
    web = df.filter(F.col(source_col).isin(*WEB) & F.col(text_col).isNotNull())
    sample = hash_sample(web.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "i", pages)
    sample = cut(sample.select(F.monotonically_increasing_id().alias("h"), "t"))
    shapes = sample.select("h", F.posexplode(F.split("t", "\n", -1)).alias("k", "line")).filter(f"length(line) <= {LONG}")
    shapes = shapes.select("h", "k", F.xxhash64(line_shape(F.col("line"))).alias("shape"))
    wanted = shapes.select("shape").distinct()
    labels = shape_labels(df, text_col, source_col).join(F.broadcast(wanted), "shape", "left_semi")
    known = {(r.h, r.k): r.furniture for r in shapes.join(labels, "shape").collect()}  # lines of FIT_PAGES pages at most
    rows = sample.collect()
    empty = np.zeros(PAIRS, np.float32)
    lines = Lines([r.t for r in rows])
    y = np.full(len(lines.lines), -1)
    for j, (p, k) in enumerate(zip(lines.page, lines.number)):
        line = lines.lines[j]
        if len(line) > LONG:
            y[j] = 0 if line.rstrip()[-1] in _STOPS else -1
        else:
            y[j] = known.get((rows[p].h, int(k)), -1)
    if not (y == 1).sum() or not (y == 0).sum():
        return Model(empty, None)
    # attribute tokens: log odds of character pairs, from one half of the pages for the other while fitting
    half = lines.page % 2

    def table(use: np.ndarray) -> np.ndarray:
        c = np.zeros((2, PAIRS))
        for v in (0, 1):
            part = [lines.lines[j] for j in np.flatnonzero(use & (y == v))]
            if part:
                np.add.at(c[v], _pairs(codes("\n".join(part) + "\n")), 1)
        f, k = c[1] / max(c[1].sum(), 1), c[0] / max(c[0].sum(), 1)
        seen = c.sum(0) >= 2
        return np.where(seen, np.clip(np.log((f + 1e-6) / (k + 1e-6)), -5, 5), 0).astype(np.float32)

    x = np.where((half == 0)[:, None], lines.features(table(half == 1)), lines.features(table(half == 0)))
    use = y >= 0
    w = np.where(y[use] == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * use.sum()
    return Model(table(use), BoostedTrees().fit(x[use].astype(np.float64), y[use].astype(float), w))


def _chunks(values: list, size: int = 500):
    for k in range(0, len(values), size):
        yield k, values[k : k + size]


def furniture_lines(df: DataFrame, id_col: str = "record_id", text_col: str = "text", source_col: str = "source", model: Model | None = None) -> DataFrame:
    """(record_id, line_no): every line of a web page that is not its main content."""
    model = model or fit(df, id_col, text_col, source_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), dtype=object)
            for at, part in _chunks(b.column(1).to_pylist()):
                page, number = m.furniture(part)
                keys = ids[at : at + len(part)][page] if len(page) else np.zeros(0, np.int64)
                ok = [k is not None for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k in keys if k is not None], pa.int64()), pa.array(number[np.array(ok, bool)] if len(ok) else number, pa.int64())], names=["record_id", "line_no"]
                )

    web = df.filter(F.col(source_col).isin(*WEB)).select(F.col(id_col).cast("bigint"), text_col)
    return web.mapInArrow(run, "record_id bigint, line_no bigint")


def main_text(df: DataFrame, id_col: str = "record_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``df`` with the text of web pages cut down to their main content."""
    shared = df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col, source_col))

    @F.pandas_udf("string")
    def body(s):
        out = []
        for _, part in _chunks(s.tolist()):
            page, number = shared.value.furniture(part)
            drop: dict[int, set] = {}
            for p, k in zip(page.tolist(), number.tolist()):
                drop.setdefault(p, set()).add(k)
            out += [t if t is None or p not in drop else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[p]) for p, t in enumerate(part)]
        return s.__class__(out, index=s.index, dtype=object)

    return df.withColumn(text_col, F.when(F.col(source_col).isin(*WEB), body(F.col(text_col))).otherwise(F.col(text_col)))
