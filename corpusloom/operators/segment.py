"""Segmentation of cleaned text into records of bounded length: splitters and the ordered folds that pack them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.pytext import BLANKS, WS, bind, expand, multiline, non_empty, sql_quote, sql_strip, strip
from corpusloom.operators.patent import CN_ID, PAGE_OF, SECTION_HEADERS

SENTENCE_PATENT = "。！？；\n"
SENTENCE_REGULATION = "。！？；"
_MARK, _STOP = "\u0001", "\u0002"


def _strings(c: Column) -> Column:
    return c.cast("array<string>")


def pack_sentences(text: Column, longest: int, ends: str = SENTENCE_PATENT) -> Column:
    """Sentences packed greedily up to ``longest`` signs; a longer sentence stands alone, uncut."""
    state = F.struct(_strings(F.array()).alias("out"), F.lit("").alias("cur"))
    push = lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(strip(a["cur"])))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        blank = strip(x) == ""
        fits = F.length(a["cur"]) + F.length(x) <= longest
        return F.struct(
            F.when(blank | fits, a["out"]).otherwise(push(a)).alias("out"),
            F.when(blank, a["cur"]).when(fits, F.concat(a["cur"], x)).otherwise(x).alias("cur"),
        )

    return F.aggregate(F.split(text, f"(?<=[{ends}])", -1), state, step, push)


def merge_groups(groups: Column, shortest: int, longest: int, long_split) -> Column:
    """Groups under ``shortest`` merged with the next, groups over ``longest`` split; a short tail joins the last record.

    ``long_split`` depends on the group alone, so it runs before the fold and the fold holds no other."""
    items = F.transform(groups, lambda g: F.struct(g.alias("g"), F.when(F.length(g) > longest, long_split(g)).otherwise(_strings(F.array())).alias("parts")))
    state = F.struct(_strings(F.array()).alias("out"), F.lit("").alias("buf"))
    flushed = lambda a: F.when(a["buf"] != "", F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        over = F.length(x["g"]) > longest
        n = F.length(a["buf"])
        join = (n > 0) & (n < shortest) & (n + 1 + F.length(x["g"]) <= longest)
        return F.struct(
            F.when(over, F.concat(flushed(a), x["parts"])).when(join, a["out"]).otherwise(flushed(a)).alias("out"),
            F.when(over, F.lit("")).when(join, F.concat_ws("\n", a["buf"], x["g"])).otherwise(x["g"]).alias("buf"),
        )

    def finish(a: Column) -> Column:
        n = F.size(a["out"])
        last = F.concat(F.slice(a["out"], 1, n - 1), F.array(F.concat_ws("\n", F.get(a["out"], n - 1), a["buf"])))
        return F.when(a["buf"] == "", a["out"]).when((F.length(a["buf"]) < shortest) & (n > 0), last).otherwise(flushed(a))

    return F.aggregate(items, state, step, finish)


def split_sections(text: Column) -> Column:
    """Sections at lines that are only a known header, the header kept as first line; leftover page marks of claims gone."""
    heads = "|".join(SECTION_HEADERS)
    marked = F.regexp_replace(text, multiline(rf"(?:^|\n)({heads})\s*[:：]?\s*(?=\n|$)"), f"{_MARK}$1{_STOP}")
    page = expand(rf"\A(?:{CN_ID}\s*\n)?{PAGE_OF}\s*\n?")

    def section(part: Column, i: Column) -> Column:
        header, content = F.substring_index(part, _STOP, 1), strip(F.substring_index(part, _STOP, -1))
        content = F.when(header.isin("权利要求书", "权利要求"), strip(F.regexp_replace(content, page, ""))).otherwise(content)
        body = F.when(content == "", header).otherwise(F.concat_ws("\n", header, content))
        return F.when((i == 0) & ~part.contains(_STOP), strip(part)).otherwise(strip(body))

    return F.filter(F.transform(F.split(marked, _MARK, -1), section), lambda x: x != "")


def split_paragraphs(section: Column) -> Column:
    """The first rule that divides: numbered paragraphs, numbered items, blank lines; else the section whole."""
    rules = (r"\n(?=\[\d{4}\])", r"\n(?=[一-鿿\p{Nd}]+[、．.．])", r"\n\n+")
    c = F
    out = c.array(strip(section))
    for rule in reversed(rules):
        parts = F.split(section, expand(rule), -1)
        out = F.when(F.size(parts) >= 2, non_empty(parts)).otherwise(out)
    return F.when(strip(section) == "", _strings(F.array())).otherwise(out)


def split_long(text: Column, longest: int) -> Column:
    """A long patent group: at numbered paragraphs, what is still too long at sentences."""
    parts = F.split(text, expand(r"\n(?=\[\d{4}\])"), -1)
    one = lambda p: F.when(F.length(p) > longest, pack_sentences(p, longest)).otherwise(F.array(p))
    return F.when(F.size(parts) >= 2, F.flatten(F.transform(F.filter(parts, lambda p: p != ""), one))).otherwise(pack_sentences(text, longest))


def segment_patent(text: Column, shortest: int = 50, longest: int = 2000) -> Column:
    """Records of a cleaned patent text, in order."""
    groups = F.flatten(F.transform(split_sections(text), split_paragraphs))
    out = bind(groups, lambda g: merge_groups(g, shortest, longest, lambda x: split_long(x, longest)))
    return F.when(strip(text) == "", _strings(F.array())).otherwise(out)


SECTION_RULE = r"\n(?=\s*[一二三四五六七八九十]{1,3}[、．.])"


def split_long_regulation(text: Column, longest: int) -> Column:
    """A long regulation group: at blank lines, what is still too long at sentences."""
    parts = non_empty(F.split(text, "\n\n+", -1))
    one = lambda p: F.when(F.length(p) > longest, pack_sentences(p, longest, SENTENCE_REGULATION)).otherwise(F.array(p))
    return F.when(F.size(parts) >= 2, F.flatten(F.transform(parts, one))).otherwise(pack_sentences(text, longest, SENTENCE_REGULATION))


def segment_regulation(text: Column, shortest: int = 120, longest: int = 2000) -> Column:
    """Records of a cleaned regulation text: Chinese-numbered sections, else paragraphs, merged and split."""
    sections = non_empty(F.split(text, expand(SECTION_RULE), -1))
    paragraphs = non_empty(F.split(text, "\n\n+", -1))
    groups = bind(sections, lambda s: F.when(F.size(s) <= 1, paragraphs).otherwise(s))
    out = bind(groups, lambda g: merge_groups(g, shortest, longest, lambda x: split_long_regulation(x, longest)))
    return F.when(strip(text) == "", _strings(F.array())).otherwise(out)


# --- SQL: WITH steps over exploded parts; the folds over list_reduce ------------------------------------------------


def _parts(e: str, rule: str) -> str:
    """``e`` divided before every match of a rule's group; for a rule without one, at the match."""
    return f"string_split(regexp_replace({e}, {sql_quote(expand(rule))}, chr(1) || '\\1', 'g'), chr(1))"


def _kept(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda y: {sql_strip('y')}), lambda z: z <> '')"


NUMBERED, ITEMS, BLANK_LINES = r"\n(\[\d{4}\])", r"\n([一-鿿\p{Nd}]+[、．.])", r"\n\n+()"
CHINESE_NUMBERED = r"\n(\s*[一二三四五六七八九十]{1,3}[、．.])"


def sql_section_steps(source: str, key: str, text: str) -> str:
    """Steps whose last, ``sec``, has (key, i, s): sections of the text. Line ends are doubled, so that a header line can
    take one of either side without looking ahead."""
    flat = "[" + BLANKS.replace(r"\t-\r", r"\t\x0b-\r") + "]"
    head = f"\\n({'|'.join(SECTION_HEADERS)})(?:{WS}*[:：])?{flat}*\\n"
    doubled = f"chr(10) || replace({text}, chr(10), chr(10) || chr(10)) || chr(10)"
    content = sql_strip("split_part(p, chr(2), 2)")
    page = expand(rf"\A(?:{CN_ID}\s*\n)?{PAGE_OF}\s*\n?")
    claims = f"CASE WHEN h IN ('权利要求书', '权利要求') THEN {sql_strip(f'regexp_replace(t, {sql_quote(page)}, {sql_quote("")})')} ELSE t END"
    body = sql_strip("CASE WHEN NOT contains(p, chr(2)) THEN p WHEN t = '' THEN h ELSE h || chr(10) || t END")
    return (
        f"s0 AS (SELECT {key}, string_split(regexp_replace({doubled}, {sql_quote(head)}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM {source}), "
        f"s1 AS (SELECT {key}, i, replace(ps[i], chr(10) || chr(10), chr(10)) AS p FROM (SELECT {key}, ps, unnest(range(1, len(ps) + 1)) AS i FROM s0)), "
        f"s2 AS (SELECT {key}, i, p, split_part(p, chr(2), 1) AS h, {content} AS t FROM s1), s3 AS (SELECT {key}, i, p, h, {claims} AS t FROM s2), "
        f"sec AS (SELECT {key}, i, s FROM (SELECT {key}, i, {body} AS s FROM s3) WHERE s <> '')"
    )


def sql_paragraphs(s: str) -> str:
    a, b, c = (_parts(s, r) for r in (NUMBERED, ITEMS, BLANK_LINES))
    whole = sql_strip(s)
    return f"CASE WHEN {whole} = '' THEN [] WHEN len({a}) >= 2 THEN {_kept(a)} WHEN len({b}) >= 2 THEN {_kept(b)} WHEN len({c}) >= 2 THEN {_kept(c)} ELSE [{whole}] END"


def sql_long_steps(key: str, longest: int, patent: bool) -> str:
    """Steps from ``gs`` (key, i, j, g) to ``lp`` (key, i, j, parts): the parts of every group longer than ``longest``."""
    x = _parts("g", NUMBERED if patent else BLANK_LINES)
    several = f"list_filter({x}, lambda z: z <> '')" if patent else _kept(x)
    size = f"len({x})" if patent else f"len({_kept(x)})"
    packed = sql_pack_sentences("part", longest, SENTENCE_PATENT if patent else SENTENCE_REGULATION)
    return (
        f"l1 AS (SELECT {key}, i, j, CASE WHEN {size} >= 2 THEN {several} ELSE [g] END AS ps FROM gs WHERE length(g) > {longest}), "
        f"l2 AS (SELECT {key}, i, j, k, ps[k] AS part FROM (SELECT {key}, i, j, ps, unnest(range(1, len(ps) + 1)) AS k FROM l1)), "
        f"l3 AS (SELECT {key}, i, j, k, part, CASE WHEN length(part) > {longest} THEN {packed} END AS st FROM l2), "
        f"lp AS (SELECT {key}, i, j, flatten(list(CASE WHEN st IS NULL THEN [part] ELSE {sql_packed('st')} END ORDER BY k)) AS parts FROM l3 GROUP BY {key}, i, j)"
    )


def sql_group_steps(source: str, key: str, text: str, kind: str) -> str:
    """Steps whose last, ``gs``, has (key, i, j, g): the groups of a cleaned text before they are merged and split."""
    if kind == "patent":
        return (
            sql_section_steps(f"(SELECT * FROM {source} WHERE {sql_strip(text)} <> '')", key, text)
            + f", par AS (SELECT {key}, i, {sql_paragraphs('s')} AS ps FROM sec), gs AS (SELECT {key}, i, j, ps[j] AS g FROM (SELECT {key}, i, ps, unnest(range(1, len(ps) + 1)) AS j FROM par))"
        )
    a, b = _kept(_parts(text, CHINESE_NUMBERED)), _kept(_parts(text, BLANK_LINES))
    return (
        f"par AS (SELECT {key}, CASE WHEN len({a}) <= 1 THEN {b} ELSE {a} END AS ps FROM {source} WHERE {sql_strip(text)} <> ''), "
        f"gs AS (SELECT {key}, 1 AS i, j, ps[j] AS g FROM (SELECT {key}, ps, unnest(range(1, len(ps) + 1)) AS j FROM par))"
    )


def sql_segment_steps(source: str, key: str, text: str, kind: str, shortest: int, longest: int) -> str:
    """Steps whose last, ``segments``, has (key, seg_no, segment), from (key, text) of a cleaned source."""
    return (
        sql_group_steps(source, key, text, kind) + ", " + sql_long_steps(key, longest, kind == "patent") + ", "
        f"g3 AS (SELECT {key}, list({{'g': g, 'parts': coalesce(parts, []::VARCHAR[])}} ORDER BY i, j) AS gs FROM gs LEFT JOIN lp USING ({key}, i, j) GROUP BY {key}), "
        f"m AS (SELECT {key}, {sql_merge_groups('gs', shortest, longest)} AS m FROM g3), o AS (SELECT {key}, {sql_merged('m', shortest)} AS segs FROM m), "
        f"segments AS (SELECT {key}, CAST(i - 1 AS INTEGER) AS seg_no, segs[i] AS segment FROM (SELECT {key}, segs, unnest(range(1, len(segs) + 1)) AS i FROM o))"
    )


def sql_pack_sentences(e: str, longest: int, ends: str = SENTENCE_REGULATION) -> str:
    """``e`` must be a name in scope; the sentences come as one-element states."""
    pieces = f"string_split(regexp_replace({e}, {sql_quote('([' + ends + '])')}, '\\1' || chr(1), 'g'), chr(1))"
    first = f"list_prepend({{'out': []::VARCHAR[], 'cur': ''}}, list_transform(list_filter({pieces}, lambda p: {sql_strip('p')} <> ''), lambda p: {{'out': []::VARCHAR[], 'cur': p}}))"
    push = f"CASE WHEN s.cur <> '' THEN list_append(s.out, {sql_strip('s.cur')}) ELSE s.out END"
    step = f"CASE WHEN length(s.cur) + length(x.cur) <= {longest} THEN {{'out': s.out, 'cur': s.cur || x.cur}} ELSE {{'out': {push}, 'cur': x.cur}} END"
    return f"list_reduce({first}, lambda s, x: {step})"


def sql_packed(state: str) -> str:
    return f"CASE WHEN {state}.cur <> '' THEN list_append({state}.out, {sql_strip(state + '.cur')}) ELSE {state}.out END"


def sql_merge_groups(groups: str, shortest: int, longest: int) -> str:
    """``groups``: list of structs (g, parts); gives the state (out, buf)."""
    init = "{'out': []::VARCHAR[], 'buf': '', 'g': '', 'parts': []::VARCHAR[]}"
    first = f"list_prepend({init}, list_transform({groups}, lambda p: {{'out': []::VARCHAR[], 'buf': '', 'g': p.g, 'parts': p.parts}}))"
    flushed = "CASE WHEN s.buf <> '' THEN list_append(s.out, s.buf) ELSE s.out END"
    make = lambda out, buf: f"{{'out': {out}, 'buf': {buf}, 'g': '', 'parts': []::VARCHAR[]}}"
    step = (
        f"CASE WHEN length(x.g) > {longest} THEN {make(f'list_concat({flushed}, x.parts)', chr(39) * 2)} "
        f"WHEN length(s.buf) > 0 AND length(s.buf) < {shortest} AND length(s.buf) + 1 + length(x.g) <= {longest} THEN {make('s.out', 's.buf || chr(10) || x.g')} "
        f"ELSE {make(flushed, 'x.g')} END"
    )
    return f"list_reduce({first}, lambda s, x: {step})"


def sql_merged(m: str, shortest: int) -> str:
    tail = f"list_append({m}.out[:len({m}.out) - 1], {m}.out[len({m}.out)] || chr(10) || {m}.buf)"
    return f"CASE WHEN {m}.buf = '' THEN {m}.out WHEN length({m}.buf) < {shortest} AND len({m}.out) > 0 THEN {tail} ELSE list_append({m}.out, {m}.buf) END"
