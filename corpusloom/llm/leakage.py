"""Evaluation texts leaking into training text.

Both sides are reduced to letters and digits in lower case and ordinary width. A document leaks an item when both have
at least ``passage`` consecutive reduced characters in common.

Size-partitioned MinHash containment search: the items' reduced texts are partitioned by size, and the sets that are
sketched are not whole texts (a short item would drown in a long document) but every run of ``passage`` characters, the
smallest set that counts as a leak; so at the boundary both sets have the same size and the containment threshold turns
into Jaccard 1. The MinHash of a run's k-gram shingles is then equal on both sides with certainty, one permutation
suffices, and no leak is missed. Each document is sketched in one narrow pass over its whole text (sliding minima, about
two fingerprints per passage kept); matches with an item's fingerprints are verified by exact comparison around the
shared shingle, in the same pass, so no text is shuffled.

Items of at most ``INDEX_CHARS`` characters in all are indexed by size class and broadcast; more of them meet the
documents by a shuffle of both sides' fingerprints instead, still in one scan of the documents. Defined cases: null or
short texts (under ``passage`` reduced characters) match nothing, nor do null ids; empty tables give no
rows; repeated rows and copies are each reported, equal result rows once; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import gram_hashes, pieces, reduced, window_min

#: Characters of all items up to which their index is broadcast (about 30 bytes each in a task).
INDEX_CHARS = 2_000_000
SHINGLE = 20


def fingerprints(values: np.ndarray, owner: np.ndarray, passage: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the minimum shingle of every passage-long run; runs over a change of owner don't count."""
    h = gram_hashes(values, k)
    w = passage - k + 1
    m = window_min(h, w)
    if not len(m):
        return h[:0], np.zeros(0, np.int64)
    inside = owner[: len(m)] == owner[passage - 1 :][: len(m)]
    # a shingle is kept if it is the minimum of at least one run that covers it
    least = np.full(len(h), False)
    top = np.where(inside, m, np.uint64(0))
    # maximum over the runs covering a shingle of their minimum equals its own hash iff it is a minimum somewhere
    pad = np.concatenate([np.zeros(w - 1, np.uint64), top, np.zeros(w - 1, np.uint64)])
    cover = ~window_min(~pad, w)
    least = (cover == h) & (h != 0)
    at = np.flatnonzero(least)
    return h[at], at


class ItemIndex:
    """Sorted fingerprints of the items of one size class, with the reduced texts for verification."""

    def __init__(self, ids: list[int], texts: list[str], passage: int):
        self.passage, self.ids = passage, ids
        self.texts = [reduced(t) for t in texts]
        hs, own, pos = [], [], []
        for values, owner, offset in pieces(self.texts, passage - 1):
            h, at = fingerprints(values, owner, passage)
            hs.append(h)
            own.append(owner[at])
            pos.append(offset[at])
        if hs:
            h = np.concatenate(hs)
            order = np.argsort(h, kind="stable")
            self.h, self.own, self.pos = h[order], np.concatenate(own)[order], np.concatenate(pos)[order]
        else:
            self.h, self.own, self.pos = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def search(self, texts: list[np.ndarray], h: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item index, longest common run) of every leak in the reduced texts, by their fingerprints."""
        best: dict[tuple[int, int], int] = {}
        lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        for j in np.flatnonzero(hi > lo):
            row, p = int(owner[j]), int(offset[j])
            for x in range(lo[j], hi[j]):
                item = int(self.own[x])
                run = common_run(texts[row], p, self.texts[item], int(self.pos[x]))
                if run >= self.passage:
                    best[row, item] = max(best.get((row, item), 0), run)
        for (row, item), run in best.items():
            yield row, item, run


def common_run(a: np.ndarray, p: int, b: np.ndarray, q: int) -> int:
    """Length of the longest common run of a and b that aligns a[p] with b[q] and covers it."""
    n = min(len(a) - p, len(b) - q)
    d = np.flatnonzero(a[p : p + n] != b[q : q + n])
    fore = int(d[0]) if len(d) else n
    m = min(p, q)
    d = np.flatnonzero(a[p - m : p][::-1] != b[q - m : q][::-1])
    return fore + (int(d[0]) if len(d) else m)


class SizedIndex:
    """An index for each size class of the items (powers of two of the length)."""

    def __init__(self, rows: list[tuple[int, str]], passage: int):
        classes: dict[int, list[tuple[int, str]]] = {}
        for i, t in rows:
            classes.setdefault(len(t).bit_length(), []).append((i, t))
        self.parts = [ItemIndex([i for i, _ in c], [t for _, t in c], passage) for _, c in sorted(classes.items())]


def marks(df: DataFrame, key: str, text: str, passage: int) -> DataFrame:
    """(key, h, at): the fingerprints of every passage-long run of each text, and where they stand in the reduced text."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for values, owner, offset in pieces([reduced(t) if t else np.zeros(0, np.uint32) for t in b.column(1).to_pylist()], passage - 1):
                h, at = fingerprints(values, owner, passage)
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner[at]], pa.int64()), pa.array(h.view(np.int64)), pa.array(offset[at], pa.int64())], names=[key, "h", "at"])

    return df.select(key, text).mapInArrow(run, f"{key} bigint, h bigint, at bigint").distinct()


def _joined_leaks(docs: DataFrame, items: DataFrame, passage: int) -> DataFrame:
    """Leaks of any number of items: fingerprints of both sides meet by shuffle, then the texts of what met are compared."""
    met = marks(docs, "d", "t", passage).join(marks(items, "i", "x", passage).withColumnRenamed("at", "q"), "h")
    met = met.groupBy("d", "i").agg(F.collect_set(F.struct("at", "q")).alias("at"))
    both = met.join(items.dropDuplicates(["i", "x"]), "i").join(docs.dropDuplicates(["d", "t"]), "d").select("d", "i", "t", "x", "at")

    def run(batches):
        for b in batches:
            rows = []
            for d, i, t, x, at in zip(*(b.column(c).to_pylist() for c in range(5))):
                a, c = reduced(t), reduced(x)
                fits = [common_run(a, p["at"], c, p["q"]) for p in at if p["at"] < len(a) and p["q"] < len(c)]
                if fits and max(fits) >= passage:
                    rows.append((d, i, max(fits)))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["doc_id", "item_id", "run"])

    return both.mapInArrow(run, "doc_id bigint, item_id bigint, run bigint")


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", passage: int = 60, index_chars: int = INDEX_CHARS
) -> DataFrame:
    """(doc_id, item_id, run): every document with the items it gives away and the longest common run."""
    src = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(doc_text).alias("t")).filter("d is not null")
    asked = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("x")).filter("x is not null and i is not null")
    chars = asked.agg(F.sum(F.length("x"))).first()[0] or 0
    if chars > index_chars:
        out = _joined_leaks(src, asked, passage)
    else:
        shared = docs.sparkSession.sparkContext.broadcast([(r.i, r.x) for r in asked.collect()])

        def scan(batches):
            index = SizedIndex(shared.value, passage)
            for b in batches:
                keys, found = b.column(0).to_pylist(), []
                texts = [reduced(t) if t else np.zeros(0, np.uint32) for t in b.column(1).to_pylist()]
                for values, owner, offset in pieces(texts, passage - 1):
                    h, at = fingerprints(values, owner, passage)
                    for part in index.parts:
                        found += [(keys[r], part.ids[x], n) for r, x, n in part.search(texts, h, owner[at], offset[at])]
                found = sorted(set(found))
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], names=["doc_id", "item_id", "run"])

        out = src.mapInArrow(scan, "doc_id bigint, item_id bigint, run bigint")
    return out.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))
