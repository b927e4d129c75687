"""Near-duplicate records with small edits.

Two texts, blanks deleted, are near duplicates when the number of 5-character shingles in both is at least ``threshold``
of a whole that ``measure`` names:

* ``union``: those in at least one of the two (TESTDATA's case); the Hamming distance of the shingle vectors is then at most
  (1 - threshold) of their union.
* ``smaller``: those of the smaller text, so that a text within a longer one counts; the distance is then one-sided, from the
  smaller to the larger.

Pigeonring filtering. The space of shingle hashes is divided into boxes, laid out on a ring; a segment is what a text has
in one box. By the pigeonring principle a pair within the distance has some chain of consecutive boxes each of whose
prefixes keeps within the share of the distance that falls to it. This is asked twice before the full Hamming check:

* Meeting. Each of ``RING`` boxes is known by its least hash. Texts meet in chains of two boxes (three for the union, where
  a pair shares at least ``threshold`` of its least hashes on average) without a difference there, and every two of them are
  compared, however many share the chain: a hot chain is divided into blocks and every two blocks meet in a task of their
  own. So whether a pair is found depends on its two texts alone; the comparisons of a passage that a fixed share of the
  records holds grow with the square of their number.
* Pruning. In sketches of two and then of sixteen boxes (bits set by a fixed share of the shingles) the cumulative differences
  of some chain around the whole ring have to keep within the proportional budget, each prefix with the sampling noise of
  its own length.

The full check then counts shingles on complete texts. Copies (equal once blanks are deleted) are one entity in all this
and are brought back at the end. Recall is not guaranteed; README gives the measured one.

Defined cases: null text pairs with nothing; texts of fewer than five signs have no shingles and pair with nothing;
repeated rows give each pair once; ids decide a < b; other columns are not looked at.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import PIECE, codes, gram_hashes, pieces
from corpusloom.session import bounded, cut, hash_sample, maybe_broadcast

SHINGLE = 5
#: Boxes of the ring on which texts meet.
RING = 32
#: Sketches of 64-bit words, a word for each box of a ring of their own, which travel with every box of a text; one shingle
#: of so many sets a bit. Deviations of the sampling noise that a pair may stay below the threshold.
SMALL, SMALL_RATE, LARGE, LARGE_RATE, SURE = 2, 12, 16, 2, 2.0
#: For each measure: boxes of a chain in which texts meet, deviations of the sampling noise.
MEASURES = {"smaller": (2, SURE), "union": (3, 3.5)}
#: A chain is hot, and its texts are divided into blocks, when it holds more than this many rows and one in 50,000.
HOT, HOT_SHARE = 4_096, 50_000
#: One entity of so many is counted to find hot chains.
HOT_SAMPLE = 16
#: The boxes are shuffled in so many goes, and the pairs checked so many times the number of texts in one go, so that what
#: lies on disk at once stays in proportion to the input.
SLICES, PAIRS = 4, 2
#: Pairs looked at together; a tile's intermediate values stay in the processor's cache.
TILE = 100_000
#: Texts that lend their first signs to the compressor of the verification.
DICT_ROWS = 400

_BLANKS = re.compile("[\t\n\r \u00a0\u3000]+")


def _entity(t: str) -> int:
    return xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least hash of each box, small sketch, large sketch), a row each (blank-free) text.

    An empty box takes the value of the next one that isn't, told apart by the distance."""
    n = len(texts)
    ring = np.full(n * RING, np.uint64(2**64 - 1))
    small, large = np.zeros((n, SMALL), np.uint64), np.zeros((n, LARGE), np.uint64)
    one = np.uint64(1)
    for values, owner, _ in pieces([codes(t) for t in texts], SHINGLE - 1):
        h = gram_hashes(values, SHINGLE)
        if not len(h):
            continue
        at = owner[: len(h)] == owner[SHINGLE - 1 :]
        h, who = h[at], owner[: len(h)][at]
        np.minimum.at(ring, who * RING + ((h >> np.uint64(52)) % np.uint64(RING)).astype(np.int64), h)
        for out, words, rate, lo in ((small, SMALL, SMALL_RATE, 24), (large, LARGE, LARGE_RATE, 36)):
            k = h % np.uint64(rate) == 0
            b = (h[k] >> np.uint64(lo)) % np.uint64(words * 64)
            np.bitwise_or.at(out, (who[k], (b >> np.uint64(6)).astype(np.int64)), one << (b & np.uint64(63)))
    ring = ring.reshape(n, RING)
    empty = ring == np.uint64(2**64 - 1)
    if empty.any():
        filled = ring.copy()
        for d in range(1, RING):
            take = empty & (filled == np.uint64(2**64 - 1)) & ~np.roll(empty, -d, 1)
            filled[take] = (np.roll(ring, -d, 1)[take] >> one) ^ np.uint64(d * 0x9E3779B97F4A7C15 % (1 << 63))
        ring = filled
    return ring, small, large


def chains(ring: np.ndarray, length: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For each box of each text: hash of the chain of ``length`` boxes, and 16 bits of each of the four behind the second."""
    nxt = [np.roll(ring, -k, 1) for k in range(6)]
    with np.errstate(over="ignore"):
        key = nxt[0]
        for k in range(1, length):
            key = key * np.uint64(0x9E3779B97F4A7C15) + nxt[k]
        key = key * np.uint64(0xBF58476D1CE4E5B9) + np.arange(RING, dtype=np.uint64)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    low = np.uint64(0xFFFF)
    more = np.zeros_like(key)
    for k in range(2, 6):
        more = (more << np.uint64(16)) | ((nxt[k] >> np.uint64(4)) & low)
    return key, more


def likely(a: np.ndarray, b: np.ndarray, threshold: float, measure: str = "smaller") -> np.ndarray:
    """Whether pigeonring chains on each two sketches (rows of words, a word a box) allow ``threshold`` of the measure's whole
    to be common: some start whose chain keeps every prefix, up to the whole ring, within its budget."""
    w, sure = a.shape[1], MEASURES[measure][1]
    if measure == "union":  # shingles that share a bit only bring two sketches nearer
        own = np.bitwise_count(a | b).astype(np.float64)
        over = np.bitwise_count(a ^ b) - (1 - threshold) * own
    else:
        swap = np.bitwise_count(a).sum(1) > np.bitwise_count(b).sum(1)
        s, t = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
        own = np.bitwise_count(s).astype(np.float64)
        # a bit that is missing from the smaller's shingles may still be set in the larger by another one
        chance = np.bitwise_count(t).sum(1, keepdims=True) / (w * 64)
        over = np.bitwise_count(s & ~t) - (1 - threshold) * (1 - chance) * own
    noise = sure * np.sqrt(own.sum(1) * threshold * (1 - threshold))
    out = over.sum(1) <= noise  # the longest chain rules out most, so the others are asked of what it leaves
    over, own = over[out], own[out]
    over, own = np.concatenate([over, over[:, : w - 1]], 1).cumsum(1), np.concatenate([own, own[:, : w - 1]], 1).cumsum(1)
    over, own = np.pad(over, ((0, 0), (1, 0))), np.pad(own, ((0, 0), (1, 0)))
    alive = np.ones((len(over), w), bool)
    for n in range(1, w):
        noise = sure * np.sqrt((own[:, n : n + w] - own[:, :w]) * threshold * (1 - threshold))
        alive &= over[:, n : n + w] - over[:, :w] <= noise
    out[out] = alive.any(1)
    return out


def _words(column, words: int) -> np.ndarray:
    """Binary values of an Arrow column as rows of words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _profiles(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ent, profile): entity of each record; ring and both sketches once per entity and task."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            ids, ents, marks, pending, texts = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None or i is None:
                    continue
                x = _BLANKS.sub("", t)
                if len(x) < SHINGLE:
                    continue
                e = _entity(x)
                ids.append(i)
                ents.append(e)
                marks.append(None)
                if e not in seen:
                    if len(seen) < 2_000_000:  # beyond, an entity's profile may be made again
                        seen.add(e)
                    pending.append(len(ids) - 1)
                    texts.append(x)
            size, start = 0, 0
            for j, x in enumerate(texts):
                size += len(x)
                if size > PIECE or j == len(texts) - 1:
                    rows = np.concatenate(profiles(texts[start : j + 1]), axis=1)
                    for p, m in zip(pending[start : j + 1], rows):
                        marks[p] = m.tobytes()
                    size, start = 0, j + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ents, pa.int64()), pa.array(marks, pa.binary())], names=["id", "ent", "profile"])

    return df.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, "id bigint, ent bigint, profile binary")


def _boxes(heads: DataFrame, go: int, measure: str) -> DataFrame:
    """(ent, key, sketch): a row each box of one go of each entity of (ent, profile), with both sketches."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            key, _ = chains(np.ascontiguousarray(_words(b.column(1), RING + SMALL + LARGE)[:, :RING]), MEASURES[measure][0])
            key = key[:, go::SLICES]
            ends = pa.array(np.arange(len(key) + 1, dtype=np.int32) * key.shape[1])
            keys = pa.ListArray.from_arrays(ends, pa.array(key.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), keys, b.column(2)], names=["ent", "keys", "sketch"])

    rows = heads.select("ent", "profile", F.substring("profile", 8 * RING + 1, 8 * (SMALL + LARGE)).alias("sketch"))
    return rows.mapInArrow(run, "ent bigint, keys array<bigint>, sketch binary").select("ent", F.explode("keys").alias("key"), "sketch")


def _spread_hot(rows: DataFrame, sample: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``own`` (block of a row) and ``pair`` (which two blocks meet; not positive where a block meets itself).

    A chain counted hot in a sample is divided into blocks, and every two of them meet in a task of their own."""
    least = max(HOT, total // HOT_SHARE) // HOT_SAMPLE
    # at most HOT_SHARE chains can hold one row in HOT_SHARE, so this side is always small enough to broadcast
    hot = cut(sample.groupBy("key").count().filter(F.col("count") > least))
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.col("count"), F.lit(0)) / least)).cast("int")
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("n", n)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("ent", F.lit(9)), F.col("n")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.withColumn("pair", F.when(F.col("own") == F.col("o"), -F.col("own")).otherwise(F.least("own", "o") * F.col("n") + F.greatest("own", "o")))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new), [len(new)]])


def _blocks(starts: np.ndarray, ends: np.ndarray, pair: np.ndarray, own: np.ndarray):
    """(firsts, seconds, same) in tiles: places of rows, a line each group, of which every first has to meet every second, or
    every one behind it if both are the same rows from there on; groups of one size together."""
    size, crossed = ends - starts, pair[starts] > 0
    for d in np.unique(size[~crossed]):
        if d < 2:
            continue
        places = starts[(size == d) & ~crossed, None] + np.arange(d)
        rows = max(1, TILE // int(d))
        for k in range(0, len(places), step := max(1, TILE // int(d * d))):
            g = places[k : k + step]
            for i in range(0, d - 1, rows):
                yield g[:, i : i + rows], g[:, i:], True
    for s, e in zip(starts[crossed], ends[crossed]):  # rows of either block, one block after the other
        m = s + int(np.searchsorted(own[s:e], own[s], "right"))
        for i in range(s, m, rows := max(1, TILE // max(1, e - m))):
            if m < e:
                yield np.arange(i, min(i + rows, m))[None], np.arange(m, e)[None], False


def _bound(words: np.ndarray, threshold: float, measure: str):
    """The common bits that two of the sketches must have if they may belong to a pair, as a function of their places; the
    bound of :func:`likely` for the whole ring."""
    count, sure = np.bitwise_count(words).sum(1), MEASURES[measure][1]
    if measure == "union":
        # the whole is what both have less what is common, so the least number of common bits depends on the first alone
        both = np.arange(2 * 64 * words.shape[1] + 1)
        least, root = np.zeros(len(both), np.uint16), sure * np.sqrt(threshold * (1 - threshold))
        for n in range(64 * words.shape[1] + 1):
            least += n < threshold * np.maximum(0, both - n) - root * np.sqrt(np.maximum(0, both - n)) - 0.01
        count = count.astype(np.uint16)
        return lambda p, q: least[count[p] + count[q]]
    count = count.astype(np.float32)
    # slack for the rounding of the short form
    least = threshold * count - sure * np.sqrt(threshold * (1 - threshold) * count) - np.float32(0.01)
    chance = (1 - threshold) / (words.shape[1] * 64) * count
    return lambda p, q: np.minimum(least[p], least[q]) + chance[p] * count[q]


def _compared(key: np.ndarray, pair: np.ndarray, own: np.ndarray, words: np.ndarray, threshold: float, measure: str = "smaller"):
    """Tiles of pairs among rows sorted by (key, pair, own): every two of one chain whose sketches, small and large, allow
    ``threshold`` as a whole; all rows are held against all in the small one."""
    if not len(key):
        return
    bounds = _runs(key, pair)
    small, large = [np.ascontiguousarray(x) for x in words.T[:SMALL]], [np.ascontiguousarray(x) for x in words.T[SMALL:]]
    need, need2 = _bound(words[:, :SMALL], threshold, measure), _bound(words[:, SMALL:], threshold, measure)
    for p, q, same in _blocks(bounds[:-1], bounds[1:], pair, own):
        shared = np.bitwise_count(small[0][p][:, :, None] & small[0][q][:, None, :])
        for w in small[1:]:
            shared += np.bitwise_count(w[p][:, :, None] & w[q][:, None, :])
        ok = shared >= need(p[:, :, None], q[:, None, :])
        if same:
            ok &= np.arange(q.shape[1]) > np.arange(p.shape[1])[:, None]
        g, i, j = np.nonzero(ok)
        p, q = p[g, i], q[g, j]
        shared = np.zeros(len(p), np.float32)
        for w in large:
            shared += np.bitwise_count(w[p] & w[q])
        ok = shared >= need2(p, q)
        if ok.any():
            yield p[ok], q[ok]


def _candidates(heads: DataFrame, threshold: float, measure: str) -> DataFrame:
    """Distinct pairs (a, b) of (ent, profile) that meet in some chain and pass both sketches."""

    def run(batches):
        held: list[np.ndarray] = []

        def met(upto: int):
            ent, pair, own, key, words = (x[:upto] for x in held)
            for p, q in _compared(key, pair, own, words, threshold, measure):
                turned = ent[p] > ent[q]  # in one order, so that the outcome hangs on the two texts alone
                p, q = np.where(turned, q, p), np.where(turned, p, q)
                k = likely(words[p, :SMALL], words[q, :SMALL], threshold, measure)
                k[k] = likely(words[p[k], SMALL:], words[q[k], SMALL:], threshold, measure)
                if k.any():
                    ab = np.unique(np.stack([ent[p[k]], ent[q[k]]], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        for t in batches:
            cols = [*(t.column(c).to_numpy(zero_copy_only=False) for c in range(4)), _words(t.column(4), SMALL + LARGE)]
            held = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            if len(held[0]) < 1 << 16:
                continue
            last = _runs(held[3], held[1])[-2]  # the last group may go on
            if last:
                yield from met(int(last))
                held = [x[last:] for x in held]
        if held:
            yield from met(len(held[0]))

    some, total = heads.filter(F.pmod(F.xxhash64("ent", F.lit(7)), F.lit(HOT_SAMPLE)) == 0), heads.count() * RING
    found = []
    for go in range(SLICES):
        rows = _spread_hot(_boxes(heads, go, measure), _boxes(some, go, measure), total).select("ent", "pair", "own", "key", "sketch")
        rows = rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "own")
        found.append(cut(rows.mapInArrow(run, "a bigint, b bigint").distinct()))
    return reduce(DataFrame.unionByName, found).distinct()


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    got: list[list[np.ndarray]] = [[] for _ in texts]
    for values, owner, _ in pieces([codes(t) for t in texts], SHINGLE - 1):
        h = gram_hashes(values, SHINGLE)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for s, e in zip(first, [*first[1:], len(owner)]):
            got[owner[s]].append(h[s : max(s, e - SHINGLE + 1)])
    return [np.unique(np.concatenate(g)) if g else np.zeros(0, np.uint64) for g in got]


def common(s: np.ndarray, t: np.ndarray) -> int:
    """How many values two sorted arrays of distinct ones share; a stable sort merges two runs in one pass."""
    both = np.sort(np.concatenate([s, t]), kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _dictionary(df: DataFrame, id_col: str, text_col: str) -> bytes:
    """Stretches of at most ``DICT_ROWS`` texts that the compressor may refer to; what is compressed stays whole."""
    rows = hash_sample(df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.substring(text_col, 1, 400).alias("t")), "i", DICT_ROWS)
    return "".join(_BLANKS.sub("", r.t) for r in rows.collect()).encode("utf-8", "surrogatepass")[-(120 << 10) :]


def _texts(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame, words: bytes) -> DataFrame:
    """(ent, z): compressed blank-free text of each wanted entity (named by its least record id), one row each."""

    def run(batches):
        import zstandard

        shared = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if words else None
        pack = zstandard.ZstdCompressor(level=6, dict_data=shared).compress
        for b in batches:
            zs = [pack(_BLANKS.sub("", t).encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(zs, pa.binary())], names=["ent", "z"])

    rows = df.select(F.col(id_col).cast("bigint").alias("ent"), F.col(text_col).alias("t")).filter("t is not null")
    rows = rows.join(maybe_broadcast(wanted, 64), "ent", "left_semi").mapInArrow(run, "ent bigint, z binary")
    return rows.groupBy("ent").agg(F.max("z").alias("z"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: bytes, measure: str) -> DataFrame:
    """Pairs whose shingle sets overlap enough, with the common share of the measure's whole."""
    a = pairs.join(texts.select(F.col("ent").alias("a"), F.col("z").alias("za")), "a")
    ab = a.join(texts.select(F.col("ent").alias("b"), F.col("z").alias("zb")), "b").select("a", "b", "za", "zb")

    def run(batches):
        import zstandard

        shared = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if words else None
        unpack = zstandard.ZstdDecompressor(dict_data=shared).decompress
        known: dict[int, np.ndarray] = {}

        for b in batches:
            out = []
            for start in range(0, b.num_rows, 256):
                x, y, zx, zy = (b.column(c).slice(start, 256).to_pylist() for c in range(4))
                if len(known) > 8192:
                    known.clear()
                new = {e: z for e, z in zip(x + y, zx + zy) if e not in known}
                known.update(zip(new, shingle_sets([unpack(z).decode("utf-8", "surrogatepass") for z in new.values()])))
                for p, q in zip(x, y):
                    n, sizes = common(known[p], known[q]), (len(known[p]), len(known[q]))
                    whole = sum(sizes) - n if measure == "union" else min(sizes)
                    if n >= threshold * whole:
                        out.append((p, q, n / whole))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["a", "b", "share"])

    return ab.mapInArrow(run, "a bigint, b bigint, share double")


def linked_entities(df: DataFrame, id_col: str = "record_id", text_col: str = "text", threshold: float = 0.7, measure: str = "smaller") -> tuple[DataFrame, DataFrame]:
    """(members (id, ent), links (a, b, share) between entities): the classes of equal texts and the pairs between them."""
    known = _profiles(df, id_col, text_col)
    # an entity goes by the least id of its records
    heads = cut(known.groupBy("ent").agg(F.min("id").alias("head"), F.max("profile").alias("profile"), F.count_distinct("id").alias("copies")))
    rings = heads.select(F.col("head").alias("ent"), "profile")
    pairs = cut(_candidates(rings, threshold, measure))
    wanted = cut(pairs.select(F.col("a").alias("ent")).union(pairs.select("b")).distinct())
    words = _dictionary(df, id_col, text_col)
    texts = cut(_texts(df, id_col, text_col, wanted, words))
    goes = max(1, -(-pairs.count() // (PAIRS * max(1, heads.count()))))
    of = lambda go: pairs.filter(F.pmod(F.xxhash64("b", F.lit(3)), F.lit(goes)) == go)
    links = reduce(DataFrame.unionByName, [cut(_verified(of(go), texts, threshold, words, measure)) for go in range(goes)])
    several = heads.filter("copies > 1").select("ent", "head")
    copies = _entities(df, id_col, text_col).join(maybe_broadcast(cut(several), 64), "ent").select("id", F.col("head").alias("ent")).distinct()
    alone = heads.filter("copies = 1").select(F.col("head").alias("id"), F.col("head").alias("ent"))
    return alone.unionByName(cut(copies)), links


def _entities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ent): hash of each record's blank-free text."""

    def run(batches):
        for b in batches:
            kept = [(i, x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t is not None and i is not None and len(x := _BLANKS.sub("", t)) >= SHINGLE]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int64()), pa.array([_entity(x) for _, x in kept], pa.int64())], names=["id", "ent"])

    return df.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, "id bigint, ent bigint")


def near_pairs(df: DataFrame, id_col: str = "record_id", text_col: str = "text", threshold: float = 0.7, measure: str = "smaller") -> DataFrame:
    """(record_id_a, record_id_b), a < b: all pairs of near duplicates, copies included."""
    members, links = linked_entities(df, id_col, text_col, threshold, measure)
    links = links.select("a", "b")
    # records of one entity: only entities with several records are brought back, and only they meet themselves
    c = cut(members.filter("id <> ent").select("id", "ent"))
    c = c.unionByName(c.select(F.col("ent").alias("id"), "ent").distinct())
    more = lambda e, i: c.select(F.col("ent").alias(e), F.col("id").alias(i))
    x = links.join(more("a", "ia"), "a", "left").join(more("b", "ib"), "b", "left")
    x = x.select(F.coalesce("ia", "a").alias("ia"), F.coalesce("ib", "b").alias("ib"))
    same = c.withColumnRenamed("id", "ia").join(c.withColumnRenamed("id", "ib"), "ent").filter("ia < ib").select("ia", "ib")
    both = x.unionByName(same)
    return both.select(F.least("ia", "ib").alias("record_id_a"), F.greatest("ia", "ib").alias("record_id_b")).filter("record_id_a < record_id_b")


def near_classes(df: DataFrame, id_col: str = "record_id", text_col: str = "text", threshold: float = 0.7, measure: str = "smaller") -> DataFrame:
    """(record_id, class_id, copies, links): each record with the least id of its connected class, how many records share
    its text, and how many different texts it is linked to; records without any link or copy are left out."""
    members, links = linked_entities(df, id_col, text_col, threshold, measure)
    links = links.select("a", "b")
    head = cut(members.groupBy("ent").agg(F.min("id").alias("head"), F.count("*").alias("copies")))
    heads = head.select("ent", "head")
    edges = links.join(heads.withColumnsRenamed({"ent": "a", "head": "u"}), "a").join(heads.withColumnsRenamed({"ent": "b", "head": "v"}), "b").select("u", "v")
    both = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    # label propagation with pointer jumping, on the shared folder
    label = cut(both.select("u").distinct().withColumn("l", F.col("u")))
    while True:
        low = both.join(label.withColumnsRenamed({"u": "v", "l": "m"}), "v").groupBy("u").agg(F.min("m").alias("m"))
        new = label.join(low, "u").select("u", F.least("l", "m").alias("l"))
        jump = new.alias("x").join(new.alias("y"), F.col("x.l") == F.col("y.u"), "left").select(F.col("x.u").alias("u"), F.coalesce("y.l", "x.l").alias("l"))
        nxt = cut(jump)
        changed = nxt.join(label.withColumnRenamed("l", "old"), "u").filter("l <> old").limit(1).count()
        label = nxt
        if not changed:
            break
    degree = both.groupBy("u").count()
    info = head.join(label, head["head"] == label["u"], "left").drop("u")
    info = info.join(degree, info["head"] == degree["u"], "left").drop("u")
    info = info.select("ent", F.coalesce("l", "head").alias("class_id"), "copies", F.coalesce("count", F.lit(0)).cast("bigint").alias("links"))
    info = info.filter("copies > 1 or links > 0")
    return members.join(info, "ent").select(F.col("id").alias("record_id"), "class_id", "copies", "links")
