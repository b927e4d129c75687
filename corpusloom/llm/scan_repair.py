"""Noise in text from scanned pages.

An averaged-perceptron character editor predicts for each sign keep, replace, delete, insert (a sign behind it) or, for two
signs read for one, replace together; page-position features find the lines that a page prints around its text (numbers
that count up from page to page, lines that return word by word, the title printed again). Which line ends fall inside a
sentence, and so are joined, is decided by the sentence decoder on the text without the page's print.

The editor trains itself. Clean text of the same table (web pages) tells which signs stand in which surroundings; signs
of scanned text that never stand in theirs while exactly one other sign does give the confusion pairs, signs between two
that clean text knows as neighbours the strays, and neighbours that clean text always parts by one sign the dropped ones.
All this is counted over every record in Spark, by hash of the surroundings, each task adding up its own before the
shuffle; support is relative to the number of scanned signs. Clean lines (``FIT_ROWS`` records, least id hash: the labelled
sample of the classifier) are then corrupted with these pairs and the perceptron learns to undo it, over hashed features of
the surrounding signs and their shapes. The editor reads every scanned record whole, in one narrow pass.

Defined cases: null, empty or one-line text has no line faults but may have misread signs; other sources pass through
unchanged; a table without clean text gives an editor that keeps everything; repeated rows give equal rows; other columns
are carried along.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import lookalike
from corpusloom.llm import sentences as sent
from corpusloom.llm.arrays import PIECE, codes, counted
from corpusloom.session import cut, hash_sample

SCANNED = ("local_pdf", "zip_pdf", "http_pdf", "url_batch")
CLEAN = ("http_html", "local_html")
FIT_ROWS = 3000
FEATURES = 1 << 18
#: Occurrences of a pair from which on it counts, and the share of all scanned signs they must make up.
SUPPORT, SUPPORT_SHARE = 6, 3e-6
#: Share of a sign's places, where clean text leaves no doubt about it, in which the other must stand.
SHARE_MISREAD = 0.0006
#: Words of clean text that are known when a word is divided, the most frequent first.
MAX_WORDS = 500_000
_HAN_SIGN = re.compile("[一-鿿]")
#: Pairs of signs that are read for one.
MERGES = (("rn", "m"), ("vv", "w"), ("cl", "d"))
MARKS = "-‐‑¬­"

_PAGE = re.compile(
    r"^[\s　]*(?:[-—–~·•]*\s*\d{1,4}\s*[-—–~·•]*|第\s*\d{1,4}\s*页(?:[\s　,，]*共\s*\d{1,4}\s*页)?|\d{1,4}\s*/\s*\d{1,4}\s*页?"
    r"|(?:Page|Seite|page|PAGE)\s*\d{1,4}(?:\s*(?:of|von|sur|/)\s*\d{1,4})?|p\.\s*\d{1,4}(?:\s*/.*)?|(?:CN\s*)?[A-Z]{0,2}\s?\d{6,13}\s?[A-Z]\d?)[\s　]*$"
)
_DIGITS = re.compile(r"\d+")
_END = re.compile(r"[。！？!?；;：:，,、…”」』]\s*$|[a-zäöüß]\.\s*$")


def printed_lines(lines: list[str]) -> set[int]:
    """Numbers of the lines that a page prints outside its running text."""
    out = {k for k, x in enumerate(lines) if x.strip() and _PAGE.match(x) and (k or len(lines) > 1)}
    title = [_reduce(lines[0])] if lines else []
    if len(lines) > 1:
        title.append(_reduce(lines[0] + lines[1]))
    groups: dict[str, list[int]] = defaultdict(list)
    for k, x in enumerate(lines):
        s = x.strip()
        if k in out or not s or len(s) > 120 or _END.search(s):
            continue
        groups[_DIGITS.sub("0", s)].append(k)
        if k > 1 and len(title[0]) >= 8:
            r = _reduce(s)
            for t in title:
                if abs(len(r) - len(t)) <= 8 and len(r) >= 8 and (t in r or r in t and len(r) >= 0.9 * len(t) or _alike(r, t)):
                    out.add(k)
                    break
    for shape, ks in groups.items():
        if len(ks) < 2 or "0" not in shape:
            continue
        numbers = [list(map(int, _DIGITS.findall(lines[k])[:6])) for k in ks]
        same = all(lines[k].strip() == lines[ks[0]].strip() for k in ks)
        counting = any(all(len(a) > c and len(b) > c and b[c] == a[c] + 1 for a, b in zip(numbers, numbers[1:])) for c in range(len(numbers[0])))
        apart = all(b - a >= 3 for a, b in zip(ks, ks[1:]))
        if apart and (same and (len(ks) > 2 or not re.search("[一-鿿]{4}", shape)) or counting):
            out |= set(ks)
    return out


def _reduce(s: str) -> str:
    return re.sub(r"[\W_]+", "", s)


def _alike(a: str, b: str) -> bool:
    return a[:6] == b[:6] and difflib.SequenceMatcher(None, a, b[: len(a) + 4], False).ratio() >= 0.88


# --- the character editor -------------------------------------------------------------------------------------------

_SHAPE = None


def _shapes() -> np.ndarray:
    """Shape of a code point: digit, upper case, lower case, ideograph, blank, or a punctuation sign itself."""
    global _SHAPE
    if _SHAPE is None:
        s = np.arange(0x110000, dtype=np.uint32)
        s[0x30:0x3A] = 0x30
        s[0x41:0x5B] = 0x41
        s[0x61:0x7B] = 0x61
        s[0xC0:0x250] = 0x61
        s[0x3400:0xA000] = 0x4E00
        s[[0x20, 0xA0]] = 0x20
        _SHAPE = s
    return _SHAPE


def _level(a: np.ndarray) -> np.ndarray:
    """Signs with digits levelled."""
    return np.where((a >= 0x30) & (a <= 0x39), 0x30, a)


def _mix(*parts) -> np.ndarray:
    h = np.zeros(len(parts[-1]), np.uint64)
    for k, p in enumerate(parts):
        p = np.atleast_1d(np.asarray(p)).astype(np.uint64)
        h = (h + (p + np.uint64(k + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def features(a: np.ndarray, at: np.ndarray, width: np.ndarray, op: np.ndarray) -> np.ndarray:
    """Hashed features (rows x 8) of an operation ``op`` on the ``width`` signs at each place; ``a`` has 4 blanks at either end."""
    lv, sh = _level(a), _shapes()[a]
    x = a[at] * np.uint32(4) + width.astype(np.uint32)
    l1, l2, l3 = lv[at - 1], lv[at - 2], sh[at - 3]
    e = at + width
    r1, r2, r3 = lv[e], lv[e + 1], sh[e + 2]
    s1, s2, t1, t2 = sh[at - 1], sh[at - 2], sh[e], sh[e + 1]
    rows = (
        _mix(0, op, x), _mix(1, op, x, l1, r1), _mix(2, op, x, l2, l1), _mix(3, op, x, r1, r2), _mix(4, op, x, l2, l1, r1, r2),
        _mix(5, op, x, s1, t1), _mix(6, op, x, l3, s2, s1, t1, t2, r3), _mix(7, op, x, s2, s1, t1, t2),
    )
    return np.stack([(r % np.uint64(FEATURES)).astype(np.int64) for r in rows], 1)


KEEP, DELETE = 0, 1


def operation(to: str) -> int:
    """Code of the operation that puts ``to`` (none, one or two signs) in a place."""
    return DELETE if not to else 2 + ord(to[0]) + (ord(to[1]) << 21 if len(to) == 2 else 0)


def _signs(op: int) -> str:
    return "" if op == DELETE else chr((op - 2) & 0x1FFFFF) + (chr((op - 2) >> 21) if (op - 2) >> 21 else "")


class Editor:
    """Averaged perceptron over the operations that the confusion pairs allow for a sign."""

    def __init__(self, pairs: dict[str, list[str]]):
        #: misread sign(s) -> what they may stand for ("" = nothing)
        self.pairs = {x: sorted(set(c)) for x, c in pairs.items() if x}
        self.w = np.zeros(FEATURES, np.float32)
        self.single = np.array(sorted(ord(x) for x in self.pairs if len(x) == 1), np.uint32)
        self.double = [x for x in self.pairs if len(x) == 2]
        self.ready = False

    def places(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, width) of each sign or pair of signs that an operation other than keep is allowed for."""
        at = np.flatnonzero(np.isin(a, self.single)) if len(self.single) else np.zeros(0, np.int64)
        width = np.ones(len(at), np.int64)
        for x in self.double:
            p = np.flatnonzero((a[:-1] == ord(x[0])) & (a[1:] == ord(x[1])))
            at, width = np.concatenate([at, p]), np.concatenate([width, np.full(len(p), 2)])
        ok = (at >= 4) & (at + width + 4 <= len(a))
        return at[ok], width[ok]

    def _options(self, a, at, width):
        """(row, op code, replacement) for every place and allowed operation but keep."""
        keys = a[at].astype(np.int64) + np.where(width == 2, a[at + 1].astype(np.int64) << 21, 0)
        rows, ops, to = [], [], []
        for x, cs in self.pairs.items():
            k = ord(x[0]) + (ord(x[1]) << 21 if len(x) == 2 else 0)
            r = np.flatnonzero(keys == k)
            if not len(r):
                continue
            for c in cs:
                rows.append(r)
                ops.append(np.full(len(r), operation(c), np.int64))
                to.append(np.full(len(r), operation(c), np.int64))
        if not rows:
            z = np.zeros(0, np.int64)
            return z, z, z
        return np.concatenate(rows), np.concatenate(ops), np.concatenate(to)

    def train(self, samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 4) -> None:
        """samples: (signs, places, gold operation at each place)."""
        lag, steps = np.zeros(FEATURES), 1
        w = np.zeros(FEATURES)
        cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for epoch in range(epochs):
            for key, (a, where, gold) in enumerate(samples):
                at, width = self.places(a)
                if not len(at):
                    continue
                known = dict(zip(where.tolist(), gold.tolist()))
                want = np.array([known.get(p, KEEP) for p in at.tolist()], np.int64)
                rows, ops, _ = self._options(a, at, width)
                if not len(rows):
                    continue
                if key not in cache:
                    cache[key] = features(a, at, width, np.zeros(len(at), np.int64)), features(a, at[rows], width[rows], ops)
                fk, fo = cache[key]
                base = w[fk].sum(1)
                sc = w[fo].sum(1)
                order = np.lexsort((-sc, rows))
                first = np.unique(rows[order], return_index=True)[1]
                top = order[first]
                pick = np.full(len(at), -1, np.int64)
                pick[rows[top]] = np.where(sc[top] > base[rows[top]], top, -1)
                arg = np.where(pick >= 0, ops[np.maximum(pick, 0)], KEEP)
                goldrow = {(int(r), int(o)): j for j, (r, o) in enumerate(zip(rows, ops))}
                for k in np.flatnonzero(arg != want):
                    g = goldrow.get((int(k), int(want[k]))) if want[k] != KEEP else None
                    if want[k] != KEEP and g is None:
                        continue
                    for f, v in ((fo[g] if want[k] != KEEP else fk[k], 1.0), (fo[pick[k]] if arg[k] != KEEP else fk[k], -1.0)):
                        w[f] += v
                        lag[f] += v * steps
                steps += 1
        self.w = (w - lag / steps).astype(np.float32)
        self.ready = steps > 1

    def edits(self, a: np.ndarray) -> list[tuple[int, int, str]]:
        """(place, width, replacement) of every operation but keep on signs padded with 4 blanks at either end."""
        if not self.ready:
            return []
        at, width = self.places(a)
        if not len(at):
            return []
        rows, ops, to = self._options(a, at, width)
        keep = self.w[features(a, at, width, np.zeros(len(at), np.int64))].sum(1)
        sc = self.w[features(a, at[rows], width[rows], ops)].sum(1)
        best: dict[int, tuple[float, int]] = {}
        for j in np.flatnonzero(sc > keep[rows]):
            r = int(rows[j])
            if r not in best or sc[j] > best[r][0]:
                best[r] = (float(sc[j]), int(to[j]))
        return [(int(at[r]), int(width[r]), _signs(c)) for r, (_, c) in sorted(best.items())]


def padded(text: str) -> np.ndarray:
    b = np.full(4, 0x20, np.uint32)
    return np.concatenate([b, codes(text), b])


def joined(lines: list[str], printed: set[int]) -> tuple[str, list[tuple[int, int]]]:
    """The running text with line ends read over, and (line, offset of its start in it) of each line."""
    out, at, where = [], 0, []
    for k, x in enumerate(lines):
        if k in printed:
            continue
        s = x.strip()
        if out and s and out[-1] and (out[-1][-1].isascii() and out[-1][-1].isalpha() or out[-1][-1] in ",.;:") and s[0].isascii() and s[0].isalnum():
            out.append(" ")
            at += 1
        if out and s and out[-1] and out[-1][-1] in "-¬" and s[0].islower():
            out[-1] = out[-1][:-1]
            at -= 1
        where.append((k, at))
        out.append(s)
        at += len(s)
    return "".join(out), where


# --- fit ------------------------------------------------------------------------------------------------------------


def _windows(a: np.ndarray) -> np.ndarray:
    """Hash of the two signs before and the two after each place (digits levelled)."""
    lv = _level(a)
    return _mix(lv[:-4], lv[1:-3], lv[3:-1], lv[4:])


def _order(key: np.ndarray) -> np.ndarray:
    """Places of the hashes in an order that brings equal ones together. The upper bits and the place are sorted as one number,
    which is many times faster than an index sort; where different hashes agree in the upper bits, runs may be divided."""
    low = np.uint64((1 << max(1, len(key).bit_length())) - 1)
    return (np.sort((key & ~low) | np.arange(len(key), dtype=np.uint64)) & low).astype(np.int64)


def _surroundings(texts: DataFrame, flat) -> DataFrame:
    """(ctx, mid, n) over all texts: how often a sign (digits levelled) stands between the two signs on either side, and,
    with -1 less the sign before the gap as mid, how often two and two signs are neighbours."""

    def counts(held):
        ctx, mid = (np.concatenate(x) for x in zip(*held))
        # one mixed key sorts many times faster than two; equal keys of different pairs are as good as impossible
        key = _mix(ctx.view(np.uint64), mid.view(np.uint64))
        order = _order(key)  # a run that is divided gives two rows, which the sum behind the shuffle adds up
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        for k in range(0, len(first), 1 << 17):
            at = order[first[k : k + (1 << 17)]]
            yield pa.RecordBatch.from_arrays([pa.array(ctx[at]), pa.array(mid[at]), pa.array(n[k : k + (1 << 17)])], names=["ctx", "mid", "n"])

    def seen(parts):
        lens = np.array([len(t) for t in parts])
        a = np.concatenate([padded(t) for t in parts])
        real = np.repeat(np.tile([False, True, False], len(parts)), np.stack([np.full_like(lens, 4), lens, np.full_like(lens, 4)], 1).ravel())
        lv = _level(a)
        at, gap = real[2:-2], real[1:-2] | real[2:-1]
        near = _mix(lv[:-3], lv[1:-2], lv[2:-1], lv[3:]).view(np.int64)
        return [(_windows(a).view(np.int64)[at], lv[2:-2][at].astype(np.int64)), (near[gap], -1 - lv[1:-2][gap].astype(np.int64))]

    def run(batches):
        held, size, parts, signs = [], 0, [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and len(x := flat(t)) >= 6:
                    parts.append(x)
                    signs += len(x)
                if signs > PIECE:
                    held += seen(parts)
                    size, parts, signs = size + 2 * signs, [], 0
                if size > 4_000_000:
                    yield from counts(held)
                    held, size = [], 0
        if parts:
            held += seen(parts)
        if held:
            yield from counts(held)

    return texts.mapInArrow(run, "ctx bigint, mid bigint, n bigint").groupBy("ctx", "mid").agg(F.sum("n").alias("n"))


def confusions(clean: DataFrame, scanned: DataFrame) -> dict[str, list[str]]:
    """Misread sign -> what it may stand for ("" = a stray mark, two signs = itself and a dropped one), of (t) each."""
    known = cut(_surroundings(clean, lambda t: t))
    seen = cut(_surroundings(scanned, lambda t: joined(x := t.split("\n"), printed_lines(x))[0]))
    total = seen.filter("mid >= 0").agg(F.sum("n")).first()[0] or 0
    own = {r.mid: r.n for r in known.filter("mid >= 0").groupBy("mid").agg(F.sum("n").alias("n")).collect()}  # a row a code point at most
    per = known.filter("mid >= 0").groupBy("ctx").agg(F.sum("n").alias("all"), F.max(F.struct("n", F.col("mid").alias("c"))).alias("top"))
    sure = per.filter("all >= 4 and top.n >= 0.8 * all").select("ctx", F.col("top.c").alias("c"))
    signs, near = seen.filter("mid >= 0").withColumnRenamed("mid", "x"), seen.filter("mid < 0").select("ctx", "mid", "n")
    usual = known.filter("mid >= 0 and n >= 3").select("ctx", F.col("mid").alias("x"))
    met = signs.join(sure, "ctx")
    agreed = {r.c: r.n for r in met.filter("x = c").groupBy("c").agg(F.sum("n").alias("n")).collect()}  # a row a code point at most
    wrong = met.filter("x <> c").join(usual, ["ctx", "x"], "left_anti").groupBy("x", "c").agg(F.sum("n").alias("n"))
    beside = known.filter("mid < 0 and n >= 3").select("ctx")
    stray = signs.join(beside, "ctx", "left_semi").join(known.filter("mid >= 0").select("ctx").distinct(), "ctx", "left_anti")
    stray = stray.groupBy("x").agg(F.sum("n").alias("n")).select("x", F.lit(-1).cast("bigint").alias("c"), "n")
    dropped = near.join(known.filter("mid < 0").select("ctx"), "ctx", "left_anti").join(sure, "ctx").groupBy(F.col("mid").alias("x"), "c").agg(F.sum("n").alias("n"))
    least = max(SUPPORT, total * SUPPORT_SHARE)
    pairs = cut(wrong.unionByName(stray).unionByName(dropped))
    of = {r.x: r.n for r in pairs.groupBy("x").agg(F.sum("n").alias("n")).collect()}
    out: dict[str, list[str]] = defaultdict(list)
    for r in pairs.filter(F.col("n") >= least).orderBy("x", "c").collect():
        if r.x >= 0 and r.n >= 0.25 * of[r.x]:
            x, c = chr(r.x), "" if r.c < 0 else chr(r.c)
            if r.n < SHARE_MISREAD * agreed.get(r.c, 0):
                continue
            if _visible(x, c) or not c and x.isalnum() and own.get(r.x, 0) * 20 <= r.n and lookalike.normal(x) == x:
                out[x].append(c)
        elif r.x < 0 and r.c >= 0 and (chr(r.c).islower() or "一" <= chr(r.c) <= "鿿") and chr(-1 - r.x).isalnum() and r.n >= 0.25 * of[r.x]:
            out[chr(-1 - r.x)].append(chr(-1 - r.x) + chr(r.c))
    return out


def _visible(x: str, c: str) -> bool:
    """Whether one printed sign may have been read as the other: what only differs in storage or case is no misreading."""
    if x in " \n" or x == c or lookalike.normal(x) != x or lookalike.INVISIBLE_RE.search(x) or x == "�":
        return False
    plain = x.isascii() or "぀" <= x <= "ヿ" or "一" <= x <= "鿿"
    if c == "":
        return not x.isalnum() and x not in "“”‘’（）()《》，。、；：,.;:-—–…！？!?%/"
    return plain and x.isalnum() and c.isalnum() and x.lower() != c.lower() and (c.isascii() or "一" <= c <= "鿿")


def _digit_pairs(pairs: dict[str, list[str]]) -> dict[str, list[str]]:
    """Levelled digits taken apart again: a letter read for a digit stands for the digit it looks like, and the other way."""
    # Letters and the digits they look like.
    look = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "B": "8", "Z": "2"}
    out: dict[str, list[str]] = defaultdict(list)
    for x, cs in pairs.items():
        for c in cs:
            if c == "0":
                if x in look:
                    out[x].append(look[x])
            elif x == "0":
                for d in [v for k, v in look.items() if k == c]:
                    out[d].append(c)
            else:
                out[x].append(c)
    return out


def corrupt(text: str, pairs: dict[str, list[str]], rate: float, rng: np.random.Generator):
    """(signs, places, operations): the text with signs misread at random, and what undoes it."""
    wrong: dict[str, list[str]] = defaultdict(list)
    strays = [x for x, cs in pairs.items() if "" in cs]
    dropped = {c for cs in pairs.values() for c in cs if len(c) == 2}
    for x, cs in pairs.items():
        for c in cs:
            if len(c) == 1:
                wrong[c].append(x)
    out, places, gold = [], [], []
    r = rng.random(len(text))
    for k, (c, p) in enumerate(zip(text, r)):
        if dropped and rate <= p < 2 * rate and text[k - 1 : k + 1] in dropped and out[-1:] == [text[k - 1]]:
            places.append(len(out) + 3)
            gold.append(operation(text[k - 1 : k + 1]))
        elif p < rate and c in wrong:
            x = wrong[c][int(rng.integers(len(wrong[c])))]
            places.append(len(out) + 4)
            gold.append(operation(c))
            out += list(x)
        else:
            out.append(c)
            if strays and p > 1 - rate / 6:
                places.append(len(out) + 4)
                gold.append(DELETE)
                out.append(strays[int(rng.integers(len(strays)))])
    return padded("".join(out)), np.array(places, np.int64), np.array(gold, np.int64)


class Model:
    def __init__(self, editor: Editor, decoder: sent.Model, words: set[str]):
        self.editor, self.decoder, self.words = editor, decoder, words

    def faults(self, texts: list[str]) -> list[list[tuple[int, str]]]:
        """(line number, fault) of each text."""
        out, runs, wheres = [], [], []
        for text in texts:
            lines = text.split("\n")
            printed = printed_lines(lines)
            out.append([(k, "running") for k in printed] + self._breaks(lines, printed))
            run, where = joined(lines, printed)
            runs.append(run)
            wheres.append(where)
        for n, edits in enumerate(self.corrections(runs)):
            if edits:
                offsets = [o for _, o in wheres[n]]
                out[n] += [(k, "misread") for k in {wheres[n][max(0, bisect_right(offsets, p) - 1)][0] for p, _, _ in edits}]
        return out

    def corrections(self, runs: list[str]) -> list[list[tuple[int, int, str]]]:
        """(place, width, replacement) for each text; the texts are looked at together."""
        got: list[list[tuple[int, int, str]]] = [[] for _ in runs]
        start, size = 0, 0
        for n in range(len(runs)):
            size += len(runs[n])
            if size > PIECE // 2 or n == len(runs) - 1:
                parts = [padded(r) for r in runs[start : n + 1]]
                ends = np.cumsum([len(p) for p in parts])
                for p, width, c in self.editor.edits(np.concatenate(parts)):
                    k = int(np.searchsorted(ends, p, "right"))
                    got[start + k].append((p - 4 - (int(ends[k - 1]) if k else 0), width, c))
                start, size = n + 1, 0
        return got

    def _breaks(self, lines: list[str], printed: set[int]) -> list[tuple[int, str]]:
        out = []
        rest = [k for k in range(len(lines)) if k not in printed]
        if len(rest) < 2:
            return out
        flat = "\n".join([lines[k] for k in rest])
        spans = sent.sentences(flat, self.decoder)
        j, at = 0, 0
        for n, k in enumerate(rest[:-1]):
            line = lines[k].rstrip()
            end = at + len(line)
            at += len(lines[k]) + 1
            if not line:
                continue
            while j < len(spans) and spans[j][1] <= end - 1:
                j += 1
            inside = j < len(spans) and spans[j][0] < end < spans[j][1]
            if line[-1] in MARKS:
                following = next((lines[q].strip() for q in rest[n + 1 :] if lines[q].strip()), "")
                if following and self._divided(line, following):
                    out.append((k, "hyphen"))
                elif inside or following and following[0].isalnum():
                    out.append((k, "break"))
            elif inside:
                out.append((k, "break"))
        return out

    def _divided(self, line: str, following: str) -> bool:
        """Whether the mark at the line's end is not part of the word it stands in."""
        mark = line[-1]
        before = re.search(r"[^\W\d_]+$|[一-鿿]$", line[:-1])
        after = re.match(r"[^\W\d_]+|[一-鿿]", following)
        if mark in "¬­":
            return True
        if not before or not after:
            return False
        x, y = before[0], after[0]
        if "一" <= x[-1] <= "鿿" or "一" <= y[0] <= "鿿":
            return "一" <= x[-1] <= "鿿" and "一" <= y[0] <= "鿿"
        if (x + y).lower() in self.words:
            return True
        if (x + "-" + y).lower() in self.words:
            return False
        return y[0].islower()

    def repair(self, texts: list[str]) -> list[str]:
        """Continuous paragraphs: page print gone, divided words and broken sentences joined, misread signs put right."""
        parts, sizes = [], []
        for text, found in zip(texts, self.faults(texts)):
            faults = defaultdict(set)
            for k, f in found:
                faults[k].add(f)
            out, open_, cut_ = [], False, False
            for k, x in enumerate(text.split("\n")):
                if "running" in faults[k]:
                    continue
                s = x.strip()
                if open_ and out:
                    gap = " " if out[-1][-1:].isascii() and s[:1].isascii() and out[-1][-1:] not in "-" and s[:1].isalnum() and not out[-1][-1:].isdigit() else ""
                    out[-1] += ("" if cut_ else gap) + s
                else:
                    out.append(s)
                cut_ = "hyphen" in faults[k]
                if cut_:
                    out[-1] = out[-1][:-1]
                open_ = bool(faults[k] & {"hyphen", "break"})
            parts += out
            sizes.append(len(out))
        fixed = []
        for p, edits in zip(parts, self.corrections(parts)):
            for at, width, c in reversed(edits):
                p = p[:at] + c + p[at + width :]
            fixed.append(p)
        ends = np.cumsum([0, *sizes])
        return ["\n".join(fixed[a:b]) for a, b in zip(ends, ends[1:])]


_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def fit(df: DataFrame, id_col: str = "record_id", text_col: str = "text", source_col: str = "source", rows: int = FIT_ROWS) -> Model:
    base = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(source_col).alias("s"))
    clean, scanned = base.filter(F.col("s").isin(*CLEAN)).select("i", "t"), base.filter(F.col("s").isin(*SCANNED)).select("t")
    pairs = _digit_pairs(confusions(clean.select("t"), scanned))
    for x, c in MERGES:
        pairs.setdefault(x, []).append(c)
    editor = Editor(pairs)
    rng = np.random.default_rng(7)
    labelled = [r.t for r in hash_sample(clean, "i", rows).collect()]
    editor.train([corrupt(re.sub(r"\s*\n\s*", "", t) if k % 2 else t.replace("\n", " "), pairs, 0.03, rng) for k, t in enumerate(labelled)])
    words = counted(clean.select("t"), 1, lambda t: [(w.lower(),) for w in _WORDS.findall(t) if not _HAN_SIGN.search(w)])
    words = cut(words.filter("n >= 2").orderBy(F.desc("n"), "k0").limit(MAX_WORDS))
    return Model(editor, sent.fit(clean, "t"), {r.k0 for r in words.toLocalIterator()})


def scan_faults(df: DataFrame, id_col: str = "record_id", text_col: str = "text", source_col: str = "source", model: Model | None = None) -> DataFrame:
    """(record_id, line_no, fault) of every faulty line of scanned records."""
    shared = df.sparkSession.sparkContext.broadcast(model or fit(df, id_col, text_col, source_col))

    def run(batches):
        m = shared.value
        for b in batches:
            kept = [(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and i is not None]
            rows = [(i, k, f) for (i, _), found in zip(kept, m.faults([t for _, t in kept])) for k, f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["record_id", "line_no", "fault"]
            )

    part = df.filter(F.col(source_col).isin(*SCANNED)).select(F.col(id_col).cast("bigint"), text_col)
    return part.mapInArrow(run, "record_id bigint, line_no bigint, fault string")


def repair(df: DataFrame, id_col: str = "record_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``df`` with the text of scanned records as continuous paragraphs."""
    shared = df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col, source_col))

    @F.pandas_udf("string")
    def whole(s):
        some = [t for t in s if t]
        done = iter(shared.value.repair(some))
        return s.map(lambda t: next(done) if t else t)

    return df.withColumn(text_col, F.when(F.col(source_col).isin(*SCANNED), whole(F.col(text_col))).otherwise(F.col(text_col)))
