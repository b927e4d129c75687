"""Visually identical text with different characters.

Script sets decide which look-alike is meant: every letter of a token has a set of scripts it is used in (extended by the
scripts that share it); the intersection over the token is its resolved set. An empty intersection marks a mixed-script
token: of the scripts whose spelling covers the whole token by look-alike replacement (Latin, or one that other tokens
of the record prove), the one with the fewest replacements is taken. A token that resolves to Greek or Cyrillic alone, but whose letters all have Latin look-alikes, is a whole-script
confusable: it is respelled unless the record has other tokens that can only be that script. What remains is normalised:
canonical composition, radicals and compatibility ideographs, full-width letters and digits, kinds of space and hyphen,
characters that show nothing.

``consistent_text`` adds the normal text; ``lookalike_pairs`` finds records that read the same and are stored
differently; ``lookalike_classes`` names each record's class. Pairs come from a join on a 128-bit hash of the normal
text; classes whose members are all stored alike are dropped before it, so that a hot group of exact copies never meets
itself.

Defined cases: null text stays null and pairs with nothing; an empty or invisible text reads as the empty text; copies
(same characters) are no pair; repeated rows give each pair once; other columns pass through untouched.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import bounded, cut

# Letters of other scripts that look like a Latin letter, and that letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρυκι", "ABEZHIKMNOPTYXovpuki"))
TO_LATIN = {**CYRILLIC, **GREEK}
FROM_LATIN = {"Cyrl": {v: k for k, v in CYRILLIC.items()}, "Grek": {v: k for k, v in GREEK.items()}}
#: Code points that show nothing: soft hyphen, joiners, zero-width, direction and variation marks, fillers.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"

INVISIBLE_RE = _INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_ODD = re.compile(f"[\u0009\u000d ̀-ͯ - ‐‑  ⺀-⿟　豈-﫿０-９Ａ-Ｚａ-ｚͰ-ԯΩKÅ\U0002f800-\U0002fa1f{INVISIBLE}]| \n| $")
_SPACE = re.compile("[\t\r   -   　]")
_TRAIL = re.compile(" +(?=\n|$)")
_LETTERS = re.compile("[A-Za-zÀ-ɏ̀-ͯͰ-ԯḀ-῿]+")
_FOREIGN = re.compile("[Ͱ-ԯἀ-῿]")


@lru_cache(None)
def script(c: str) -> str:
    """Script of a letter, from its Unicode name; empty for marks and everything that is used with any script."""
    name = unicodedata.name(c, "")
    for prefix, code in (("LATIN", "Latn"), ("CYRILLIC", "Cyrl"), ("GREEK", "Grek")):
        if name.startswith(prefix):
            return code
    return ""


def resolved(token: str) -> set[str] | None:
    """Intersection of the letters' script sets; None when nothing restricts it, empty for a mixed-script token."""
    out: set[str] | None = None
    for c in token:
        if s := script(c):
            out = {s} if out is None else out & {s}
    return out


def respell(token: str, to: str) -> tuple[str, int] | None:
    """The token in one script by look-alike replacement, with the number of replacements; None if it can't be."""
    out, n = [], 0
    for c in token:
        s = script(c)
        if s and s != to:
            x = TO_LATIN.get(c) if to == "Latn" else FROM_LATIN[to].get(TO_LATIN.get(c, c))
            if x is None:
                return None
            c, n = x, n + 1
        out.append(c)
    return "".join(out), n


def consistent_scripts(text: str) -> str:
    if not _FOREIGN.search(text):
        return text
    tokens = set(_LETTERS.findall(text))
    sure = set()
    for t in tokens:
        r = resolved(t)
        if r and "Latn" not in r and respell(t, "Latn") is None:
            sure |= r

    def one(m: re.Match) -> str:
        t = m[0]
        r = resolved(t)
        if r is None or r == {"Latn"}:
            return t
        if r:
            whole = respell(t, "Latn")
            return whole[0] if whole and not r & sure else t
        options = [(s != "Latn" and s not in sure, x[1], s != "Latn", x[0]) for s in ("Latn", "Cyrl", "Grek") if (x := respell(t, s))]
        return min(options)[3] if options else t

    return _LETTERS.sub(one, text)


@lru_cache(None)
def _fold(c: str) -> str:
    o = ord(c)
    if 0xFF10 <= o <= 0xFF5A:
        return chr(o - 0xFEE0)
    if c in "‐‑":
        return "-"
    if 0x2E80 <= o <= 0x2FDF:
        n = unicodedata.normalize("NFKC", c)
        return n if len(n) == 1 else c
    return c


_FOLD = re.compile("[‐‑⺀-⿟０-９Ａ-Ｚａ-ｚ]")


def normal(text: str) -> str:
    """One consistent form of the text: same reading, same result."""
    if not _ODD.search(text):
        return text
    t = _INVISIBLE.sub("", text)
    t = _SPACE.sub(" ", t)
    t = _FOLD.sub(lambda m: _fold(m[0]), t)
    t = t.replace("μ", "µ")
    t = unicodedata.normalize("NFC", t)
    t = unicodedata.normalize("NFC", consistent_scripts(t))
    return _TRAIL.sub("", t)


def consistent_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the text column in its consistent form."""

    @F.pandas_udf("string")
    def fix(s):
        return s.map(lambda t: normal(t) if t is not None else None)

    return df.withColumn(text_col, fix(F.col(text_col)))


def keyed(df: DataFrame, id_col: str = "record_id", text_col: str = "text") -> DataFrame:
    """(record_id, k1, k2, raw): hash of the normal text and of the characters as stored."""

    def run(batches):
        for b in batches:
            ids, k1, k2, raw = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None or i is None:
                    continue
                own = t.encode("utf-8", "surrogatepass")
                n = normal(t)
                h = xxhash.xxh3_128_intdigest(own if n is t else n.encode("utf-8", "surrogatepass"))
                ids.append(i)
                k1.append((h >> 64) - (1 << 63))
                k2.append((h & ((1 << 64) - 1)) - (1 << 63))
                raw.append(xxhash.xxh3_64_intdigest(own) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, k1, k2, raw)], names=["record_id", "k1", "k2", "raw"])

    return df.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, "record_id bigint, k1 bigint, k2 bigint, raw bigint")


def _members(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Records of classes with at least two stored forms."""
    rows = cut(keyed(df, id_col, text_col))
    many = rows.groupBy("k1", "k2").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo <> hi").select("k1", "k2")
    many = cut(many)
    if bounded(many, 32):
        many = F.broadcast(many)
    return rows.join(many, ["k1", "k2"], "left_semi")


def lookalike_pairs(df: DataFrame, id_col: str = "record_id", text_col: str = "text") -> DataFrame:
    """(record_id_a, record_id_b), a < b: same reading, different characters."""
    m = cut(_members(df, id_col, text_col))
    a = m.select("k1", "k2", F.col("record_id").alias("record_id_a"), F.col("raw").alias("ra"))
    b = m.select("k1", "k2", F.col("record_id").alias("record_id_b"), F.col("raw").alias("rb"))
    pairs = a.join(b, ["k1", "k2"]).filter("record_id_a < record_id_b and ra <> rb")
    return pairs.select("record_id_a", "record_id_b").distinct()


def lookalike_classes(df: DataFrame, id_col: str = "record_id", text_col: str = "text") -> DataFrame:
    """(record_id, class_id, forms): one row per record of a class with several stored forms; the class is its least id."""
    m = cut(_members(df, id_col, text_col))
    c = m.groupBy("k1", "k2").agg(F.min("record_id").alias("class_id"), F.count_distinct("raw").alias("forms"))
    return m.join(c, ["k1", "k2"]).select("record_id", "class_id", "forms").distinct()
