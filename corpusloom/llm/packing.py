"""Filling fixed-capacity containers with items.

Items are texts, measured in tokens of a public tokenizer; a text larger than the largest permitted capacity is cut into
full containers and a rest, no other is divided. Variable-capacity best fit over several permitted capacities jointly:
the largest waiting size opens a container of the capacity that leaves the least unused space once best fitting smaller
sizes have followed, relative to the capacity; at the end every container shrinks to the least capacity that holds its
contents.

What decides is only how many items there are of each size, so the packing is solved on the histogram of sizes: at most
one counter per token up to the capacity, whatever the number of rows. One pattern of sizes is used for as many
containers as the counters allow, so each step exhausts a size and the plan stays of the order of the capacity too. Items
then find their place by their rank among those of equal size, salted over buckets so that a hot size is ranked by many
tasks; the place is looked up in the broadcast plan (bounded by the capacity, not by the data).

Defined cases: null text counts as empty; an empty text has no tokens and no container (null); equal texts and repeated
rows are items of their own; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of one size that one task ranks.
RANK_ROWS = 500_000


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def measured(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens): the texts' sizes."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return df.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, "doc_id bigint, tokens bigint")


def solve(histogram: dict[int, int], capacities: Iterable[int]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Patterns (capacity, containers, [(size, items of it in each container)]) for counted sizes; sizes fit the largest capacity."""
    caps = sorted(set(capacities))
    top = caps[-1]
    count = np.zeros(top + 1, np.int64)
    for s, n in histogram.items():
        if s > 0:
            count[s] += n
    # largest waiting size at most x, kept as a union-find over exhausted sizes
    below = np.arange(top + 1)

    def fit(x: int) -> int:
        r = x
        while r > 0 and (below[r] != r or count[r] == 0):
            nxt = below[r] if below[r] != r else r - 1
            r = int(nxt)
        while x > r:
            n = int(below[x]) if below[x] != x else x - 1
            below[x] = r
            x = n
        return r

    out = []
    while (s := fit(top)) > 0:
        best = None
        for c in caps:
            if c < s:
                continue
            pattern, room = {s: 1}, c - s
            while room > 0 and (x := fit(room)) > 0:
                free = int(count[x]) - pattern.get(x, 0)
                while free <= 0 and x > 0:
                    x = fit(x - 1) if x > 1 else 0
                    free = int(count[x]) - pattern.get(x, 0) if x else 0
                if x == 0:
                    break
                take = min(room // x, free)
                pattern[x] = pattern.get(x, 0) + take
                room -= take * x
            waste = room / c
            if best is None or waste < best[0] - 1e-12 or (abs(waste - best[0]) <= 1e-12 and c > best[1]):
                best = (waste, c, pattern)
        _, c, pattern = best
        times = min(int(count[x]) // m for x, m in pattern.items())
        used = sum(x * m for x, m in pattern.items())
        for x, m in pattern.items():
            count[x] -= m * times
        out.append((next(k for k in caps if k >= used), times, sorted(pattern.items(), reverse=True)))
    return out


def _plan(patterns) -> tuple[np.ndarray, ...]:
    """Sorted lookup arrays: (size, first rank) -> items per container, first container, capacity."""
    seen: dict[int, int] = {}
    rows, base = [], 0
    for cap, times, pattern in patterns:
        for s, m in pattern:
            rows.append((s, seen.get(s, 0), m, base, cap))
            seen[s] = seen.get(s, 0) + m * times
        base += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return tuple(a[:, k].copy() for k in range(5))


def ranked(items: DataFrame, rows: int) -> DataFrame:
    """``items`` (doc_id, part_no, token_start, size) with ``rank`` among those of equal size, from 0 without gaps."""
    buckets = max(1, rows // RANK_ROWS + 1)
    salted = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(buckets)).cast("int"))
    counts = salted.groupBy("size", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("size", "bucket", before.alias("before"))
    local = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "part_no")) - 1
    return salted.withColumn("local", local).join(offsets, ["size", "bucket"]).select("doc_id", "part_no", "token_start", "size", (F.col("local") + F.col("before")).alias("rank"))


def items_of(sizes: DataFrame, largest: int) -> DataFrame:
    """Items of the texts: whole where they fit, else full parts and a rest."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(largest))).cast("int")
    x = sizes.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_no"))
    start = F.col("part_no").cast("bigint") * largest
    return x.select("doc_id", F.col("part_no").cast("bigint"), start.alias("token_start"), F.least(F.lit(largest), F.col("tokens") - start).cast("bigint").alias("size"))


def pack(sizes: DataFrame, capacities: list[int], name: str) -> DataFrame:
    """(plan, container_id, capacity_tokens, doc_id, part_no, token_start, tokens) for measured texts."""
    largest = max(capacities)
    items = items_of(sizes, largest)
    histogram = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}  # at most one row per token of the capacity
    patterns = solve(histogram, capacities)
    plan = sizes.sparkSession.sparkContext.broadcast(_plan(patterns))
    cols = "plan string, container_id bigint, capacity_tokens bigint, doc_id bigint, part_no bigint, token_start bigint, tokens bigint"

    def run(batches):
        size, first, per, base, cap = plan.value
        key = size * (1 << 44) + first
        for b in batches:
            doc, part, start, s, r = (b.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            k = np.searchsorted(key, s * (1 << 44) + r, "right") - 1
            none = s == 0
            k = np.where(none, 0, k) if len(key) else np.zeros(len(s), np.int64)
            box = base[k] + (r - first[k]) // per[k] if len(key) else np.zeros(len(s), np.int64)
            room = cap[k] if len(key) else np.zeros(len(s), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(s)), pa.array(box, pa.int64(), mask=none), pa.array(room, pa.int64(), mask=none), *(pa.array(x, pa.int64()) for x in (doc, part, start, s))],
                names=["plan", "container_id", "capacity_tokens", "doc_id", "part_no", "token_start", "tokens"],
            )

    return ranked(items, sum(histogram.values())).mapInArrow(run, cols)


def pack_all(df: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The texts packed into each capacity of the specification alone, and into all of them jointly (plan ``joint``)."""
    sizes = cut(measured(df.filter(F.col(id_col).isNotNull()), id_col, text_col, tokenizer))
    rows = specs.filter("capacity_tokens > 0").select("spec_name", "capacity_tokens").distinct().orderBy("capacity_tokens", "spec_name").collect()  # the permitted sizes, a fixed handful
    out = pack(sizes, [r.capacity_tokens for r in rows], "joint")
    for r in rows:
        out = out.unionByName(pack(sizes, [r.capacity_tokens], r.spec_name))
    return out
