"""Code-point arrays: texts of a batch as numpy arrays, cut into pieces of bounded size; counts over all texts of a table."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points handled at once; bounds the memory of the vectorised passes whatever the length of a text.
PIECE = 400_000


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(1)
def reduction() -> np.ndarray:
    """For each code point: that of its lower-case, ordinary-width form if it is a letter or digit, else 0."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for lo, hi in ((0x20, 0xD800), (0xE000, 0x10000), (0x10000, 0x323B0)):
        for o in range(lo, hi):
            c = chr(o - 0xFEE0 if 0xFF01 <= o <= 0xFF5E else o)
            if unicodedata.category(c)[0] in "LN":
                table[o] = ord(c.lower()[0])
    return table


def reduced(text: str) -> np.ndarray:
    """The text's letters and digits in lower case and ordinary width, as code points."""
    a = reduction()[codes(text)]
    return a[a != 0]


def gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-grams of a code-point array, in order."""
    n = len(a) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a = a.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    # doubling: hash of length 2^i blocks, combined for the bits of k
    block, size, at = a * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9), 1, 0
    mult = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power = mult
        rest = k
        while rest:
            if rest & 1:
                h = h * power + block[at : at + n]
                at += size
            rest >>= 1
            if rest:
                block = block[: len(block) - size] * power + block[size:]
                power = power * power
                size *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each w consecutive values."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    size, cur = 1, h
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return np.minimum(cur[:n], cur[w - size : w - size + n])


def pieces(arrays: list[np.ndarray], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (values, owner, offset) of at most about ``PIECE`` values; a longer array comes in parts that overlap."""
    buf: list[np.ndarray] = []
    own: list[tuple[int, int]] = []
    total = 0

    def flush():
        lens = [len(x) for x in buf]
        return np.concatenate(buf), np.repeat(np.array([o for o, _ in own], np.int64), lens), np.concatenate([np.arange(s, s + n) for (_, s), n in zip(own, lens)])

    for i, a in enumerate(arrays):
        start = 0
        while start < len(a):
            part = a[start : start + PIECE]
            buf.append(part)
            own.append((i, start))
            total += len(part)
            if total >= PIECE:
                yield flush()
                buf, own, total = [], [], 0
            if start + PIECE >= len(a):
                break
            start += PIECE - overlap
    if buf:
        yield flush()


def counted(texts: DataFrame, keys: int, of: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """(k0, k1, ..., n) of all texts: what ``of(text)`` yields, added up in each task before the shuffle."""
    names = [f"k{j}" for j in range(keys)]

    def run(batches):
        c: Counter = Counter()

        def out():
            rows = list(c)
            return pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in rows], pa.string()) for j in range(keys)), pa.array([c[k] for k in rows], pa.int64())], names=[*names, "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    c.update(of(t))
            if len(c) > 300_000:
                yield out()
                c.clear()
        yield out()

    rows = texts.mapInArrow(run, ", ".join(f"{k} string" for k in names) + ", n bigint")
    return rows.groupBy(*names).agg(F.sum("n").alias("n"))
