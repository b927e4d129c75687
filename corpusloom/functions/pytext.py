"""Text primitives with code-point semantics that hold alike in the JVM and in RE2.

``WS`` is the set of blanks that a Unicode-aware strip removes; line anchors see U+000A alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks, as the inside of a character class.
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{BLANKS}]"
NOT_WS = f"[^{BLANKS}]"
DIGIT = r"\p{Nd}"
HAN = "[一-鿿]"
#: The same blanks as a plain set of signs.
BLANK_SIGNS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def expand(pattern: str) -> str:
    r"""``\s``, ``\S`` and ``\d`` of a pattern spelled out; inside a class write ``{BLANKS}`` and ``\p{Nd}`` themselves."""
    return pattern.replace(r"\S", NOT_WS).replace(r"\s", WS).replace(r"\d", DIGIT)


def multiline(pattern: str) -> str:
    return "(?md)" + expand(pattern)


def strip(c: Column) -> Column:
    """Looks at the ends alone; a pattern would search the whole text for its last blanks."""
    return F.btrim(c, F.lit(BLANK_SIGNS))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def bind(value: Column, body) -> Column:
    """``body`` applied to a value computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def non_empty(c: Column) -> Column:
    """Stripped elements of an array, empty ones dropped."""
    return F.filter(F.transform(c, strip), lambda x: x != "")


# --- the same in SQL text -------------------------------------------------------------------------------------------


def sql_quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_replace(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {sql_quote('(?m)' + expand(pattern))}, {sql_quote(to)}, 'g')"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, {sql_quote(rf'\A{WS}+|{WS}+\z')}, '', 'g')"


def sql_match(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {sql_quote(expand(pattern))})"
