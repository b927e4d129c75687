"""Small fixtures for every operator: brute force, round trips, and the defined results of the odd cases."""

import os
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import gbt, leakage, lookalike, main_content, mojibake, near_dup, packing, personal, queries, scan_repair, sentences, site_lines
from corpusloom.llm.arrays import PIECE, gram_hashes, reduced, window_min

SCHEMA = "record_id bigint, text string, source_url string, source string, k1 string, site string"
rng = random.Random(5)
NAMES = "粮食储备库 交通建设局 公共资源交易站 园林养护处 市政管网公司 住房保障科".split()


def prose(n, seed):
    r = random.Random(seed)
    return "".join(f"{r.choice(NAMES)}应当于{r.randint(2000, 2999)}年{r.randint(1, 12)}月前报送编号{r.randint(10**6, 10**7)}的记录。" for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), "clash", "clash") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_site_lines(table):
    rows = [(i, f"本站所有内容仅供查阅\n独有内容第{i}行的文字\n 本站所有内容 仅供查阅  \n短", f"HTTPS://www.A.example:8080/{i}") for i in range(12)]
    rows += [(20, "本站所有内容仅供查阅", "http://b.example/"), (21, None, "http://a.example/"), (22, "本站所有内容仅供查阅", None), (23, "", ""), rows[0]]
    df = table(rows)
    got = {(r.record_id, r.line_no) for r in site_lines.frequent_line_places(df, min_docs=10).collect()}
    assert got == {(i, k) for i in range(12) for k in (0, 2)} - {(i, 2) for i in range(12)} | {(i, 2) for i in range(12)}
    clean = {r.record_id: r.text for r in site_lines.strip_frequent_lines(df, min_docs=10).collect()}
    assert clean[3] == "独有内容第3行的文字\n短" and clean[21] is None and clean[22] == "本站所有内容仅供查阅"
    assert site_lines.frequent_line_places(df.limit(0)).count() == 0
    assert site_lines.frequent_line_places(df, min_docs=13).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_trees_learn():
    g = np.random.default_rng(0)
    x = g.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.4)).astype(float)
    m = gbt.BoostedTrees(trees=40).fit(x[:3000], y[:3000])
    assert ((m.predict(x[3000:]) > 0) == y[3000:]).mean() > 0.97


def test_decode_is_hierarchical():
    z = np.array([3.0, 2.5, -0.2, 4.0, -5.0, -4.0])
    assert main_content.decode(z, np.array([0, 0, 0, 0, 1, 1])).tolist() == [True] * 4 + [False] * 2
    assert main_content.decode(np.zeros(0), np.zeros(0, int)).tolist() == []


def test_main_content(table):
    menu = ["首页 | 政策文件 | 下载中心", "分享到：朋友圈 微站", "版权所有 某某平台", "相关阅读"]
    rows = []
    for i in range(60):
        art = f"关于第{i}号项目的公告\n{prose(3, i)}\n{prose(2, 1000 + i)}\n特此公告。"
        rows.append((i, f"{menu[0]}\n{menu[i % 2 + 1]}\n{art}\n{menu[3]}\n{menu[2]}", "http://a.example", "http_html"))
        rows.append((1000 + i, art, None, "local_pdf"))
    rows += [(3000, None, None, "http_html"), (3001, "", None, "local_html"), (3002, "一行", None, None), rows[0]]
    df = table(rows)
    got = {(r.record_id, r.line_no) for r in main_content.furniture_lines(df).collect()}
    assert got >= {(i, k) for i in range(60) for k in (0, 1, 7)} - {(i, 7) for i in range(0)} and not any(k in (2, 3, 4) for _, k in got)
    text = {r.record_id: r.text for r in main_content.main_text(df).collect()}
    assert text[5].startswith("关于第5号") and text[1005].startswith("关于第5号") and text[3000] is None
    assert main_content.furniture_lines(df.limit(0)).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "a,b",
    [
        ("Notice ABC", "Notiсе АВС"), ("café", "café"), ("第12号", "第１２号"), ("a b", "a b"), ("a b", "a b"), ("项目", "项⽬"), ("ab", "a​b"),
        ("PM-1", "PM‑1"), ("The end", "Тһе end"), ("Régie", "Rе́gie"), ("line\nx", "line \nx"), ("度", "度"),
    ],
)
def test_same_reading(a, b):
    assert lookalike.normal(a) == lookalike.normal(b)


@pytest.mark.parametrize("a,b", [("12", "13"), ("привет", "npubet"), ("（a）", "(a)b"), ("工", "エ"), ("l", "1")])
def test_different_reading(a, b):
    assert lookalike.normal(a) != lookalike.normal(b)


def test_scripts_stay():
    assert lookalike.normal("Почему ток о") == "Почему ток о"
    assert lookalike.normal(lookalike.normal("Тһе ＡＢС")) == "The ABC"


def test_lookalike_pairs(table):
    df = table([(1, "第12号"), (2, "第１２号"), (3, "第12号"), (4, None), (5, ""), (6, ""), (7, "第13号"), (2, "第１２号")])
    assert sorted(map(tuple, lookalike.lookalike_pairs(df).collect())) == [(1, 2), (2, 3)]
    assert {r.record_id: (r.class_id, r.forms) for r in lookalike.lookalike_classes(df).collect()} == {1: (1, 2), 2: (1, 2), 3: (1, 2)}
    assert lookalike.consistent_text(df).filter("text is null").count() == 1
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_printed_lines():
    lines = ["关于路灯更新项目的公告（AB-1）", "正文一行", "— 29 —", "正文二行", "关于路灯更新项目的公告（AB-1）", "— 30 —", "正文三行。", "第3页 共9页", "N87635211A", "2024年"]
    assert scan_repair.printed_lines(lines) == {2, 4, 5, 7, 8}
    assert scan_repair.printed_lines([]) == set() and scan_repair.printed_lines(["17"]) == set()


def test_editor_undoes_its_noise():
    clean = [prose(6, k).replace("报送", "报送服务") for k in range(120)]
    pairs = {"O": ["0"], "l": ["1"], "曰": ["日"], "杯": ["标"], "|": [""]}
    ed = scan_repair.Editor(pairs)
    g = np.random.default_rng(1)
    ed.train([scan_repair.corrupt(t, pairs, 0.05, g) for t in clean[:100]])
    right = wrong = missed = 0
    for t in clean[100:]:
        a, places, gold = scan_repair.corrupt(t, pairs, 0.05, g)
        found = {p for p, _, _ in ed.edits(a)}
        right += len(found & set(places.tolist()))
        wrong += len(found - set(places.tolist()))
        missed += len(set(places.tolist()) - found)
    assert right > 20 * (wrong + missed + 1) / 10


def test_editor_inserts():
    """A sign dropped behind another is put back by an operation of its own."""
    clean = [prose(6, k).replace("报送", "报送仪器") for k in range(120)]
    pairs = {"仪": ["仪器"]}
    ed = scan_repair.Editor(pairs)
    g = np.random.default_rng(1)
    ed.train([scan_repair.corrupt(t, pairs, 0.2, g) for t in clean])
    a = scan_repair.padded("应当于2776年7月前报送仪编号1679215的记录。")
    assert [(w, c) for _, w, c in ed.edits(a)] == [(1, "仪器")]


def test_confusions(table):
    """Misread signs, strays and dropped signs are counted over all records."""
    clean = table([(i, prose(4, i)) for i in range(300)]).select(F.col("text").alias("t"))
    noisy = [prose(4, 900 + i) for i in range(200)]
    noisy = [t.replace("记录", "汜录") if i % 4 == 0 else t.replace("记录", "记丶录") if i % 4 == 1 else t for i, t in enumerate(noisy)]
    pairs = scan_repair.confusions(clean, table(list(enumerate(noisy))).select(F.col("text").alias("t")))
    assert pairs.get("汜") == ["记"] and pairs.get("丶") == [""]
    assert scan_repair.confusions(clean.limit(0), clean.limit(0)) == {}


def test_surroundings_are_counted(table):
    """Counts of every sign in its surroundings, however the hashes are sorted before they are added up."""
    texts = [prose(3, k % 20) for k in range(60)]
    level = lambda t: "    " + re.sub(r"\d", "0", t) + "    "
    want = sorted(Counter((x[k - 2 : k] + x[k + 1 : k + 3], x[k]) for x in map(level, texts) for k in range(4, len(x) - 4)).values())
    rows = scan_repair._surroundings(table(list(enumerate(texts))).select("text"), lambda t: t).filter("mid >= 0").collect()
    assert sorted(r.n for r in rows) == want
    key = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)[np.arange(20_000) % 500]
    order = scan_repair._order(key)
    assert sorted(order.tolist()) == list(range(len(key))) and np.count_nonzero(np.diff(key[order])) == 499
    near = np.array([5, 6, 5, 6, 5], np.uint64)  # alike but for the last bits: every place still comes once
    assert sorted(scan_repair._order(near).tolist()) == [0, 1, 2, 3, 4] and len(scan_repair._order(key[:0])) == 0


def test_repair():
    m = scan_repair.Model(scan_repair.Editor({}), sentences.Model(), {"approved"})
    text = "The board has appr-\noved the plan of the\n— 4 —\nharbour today."
    faults = set(m.faults([text])[0])
    assert {(0, "hyphen"), (1, "break"), (2, "running")} <= faults and not any(k == 3 for k, _ in faults)
    assert m.repair([text, "", "一行"]) == ["The board has approved the plan of the harbour today.", "", "一行"]
    assert m.faults(["", "一行"]) == [[], []]


# --- 5 ---------------------------------------------------------------------------------------------------------------

KNOWN = "".join(sorted(set(prose(50, 1) + "关于项目的技术规范（），：“”éäöüß")))
MAPPINGS = [("utf-8", "cp1252", 1), ("utf-8", "cp1252", 2), ("gb18030", "latin-1", 1), ("gb18030", "cp437", 1), ("utf-8", "cp1251", 1), ("utf-8", "gb18030", 1)]


@pytest.mark.parametrize("mapping", MAPPINGS, ids=str)
def test_round_trip(mapping):
    judge = mojibake.Judge(MAPPINGS, KNOWN)
    text = "关于项目的技术规范（AB-12）"
    bad = mojibake.garble("关于项目的技术规范", *mapping) + "AB-12"
    fixed = judge.fix(bad)
    assert fixed is not None and ("�" in bad or fixed == "关于项目的技术规范AB-12")
    assert judge.fix(text) is None


@pytest.mark.parametrize("text", ["├──┬──┤ 规格 │ 16 │", "λ≈0.64，φ7×64，§7，№64", "naïve façade – Größe", "%E5%85%B3", "容差 ±69µm ≤2℃", ""])
def test_meant_signs(text):
    assert mojibake.Judge(MAPPINGS, KNOWN).fix(text) is None


def test_fit_and_find(table):
    rows = [(i, f"编号AB-{i}关于项目的技术规范CD-{i}号公告\n{prose(2, i)}", "http://a.example/规范.pdf") for i in range(60)]
    rows += [(100 + i, "编号AB-7" + mojibake.garble("关于项目的技术规范", "utf-8", "cp1252", 1) + "CD-9" + mojibake.garble("号公告", "utf-8", "cp1252", 1), "http://a.example/" + mojibake.garble("规范", "utf-8", "cp1252", 1)) for i in range(4)]
    rows += [(200, None, None), (201, "", "")]
    df = table(rows)
    assert ("utf-8", "cp1252", 1) in mojibake.fit(df)[0]
    got = {(r.record_id, r.field) for r in mojibake.garbled_fields(df).collect()}
    assert got == {(100 + i, f) for i in range(4) for f in ("text", "source_url")}
    assert {r.record_id: r.text for r in mojibake.restore(df).collect()}[101].startswith("编号AB-7关于项目的技术规范CD")
    assert mojibake.garbled_fields(df.limit(0)).count() == 0


def test_aligned_code_page(table):
    """A code page that no list names is told from the aligned characters of twins."""
    bad = lambda s: mojibake.garble(s, "utf-8", "cp855", 1)
    rows = [(i, f"编号AB-{i}关于规范CD-{i}号公告EF\n{prose(2, i)}", None) for i in range(60)]
    rows += [(100 + i, f"编号AB-7{bad('关于规范')}CD-9{bad('号公告')}EF", None) for i in range(4)]
    df = table(rows)
    assert mojibake.fit(df)[0] == [("utf-8", "cp855", 1)]
    assert {r.record_id: r.text for r in mojibake.restore(df).collect()}[101] == "编号AB-7关于规范CD-9号公告EF"


# --- 6 ---------------------------------------------------------------------------------------------------------------


def brute_pairs(rows):
    sets = {}
    for i, t in rows:
        x = re.sub("[\t\n\r \xa0\u3000]", "", t or "")
        sets[i] = {x[k : k + 5] for k in range(len(x) - 4)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.7 * min(len(sets[a]), len(sets[b]))}


def test_near_pairs(table):
    rows = []
    for k in range(30):
        t = prose(8, k)
        rows += [(10 * k, t), (10 * k + 1, t.replace("应当于", "应于", 3)), (10 * k + 2, t[: len(t) // 2]), (10 * k + 3, "\n".join(t)), (10 * k + 4, prose(8, 999 + k))]
    rows += [(900, None), (901, ""), (902, "短文"), (903, "短文"), rows[0]]
    got = sorted(map(tuple, near_dup.near_pairs(table(rows)).collect()))
    truth = brute_pairs(dict(rows).items())
    assert len(got) == len(set(got)) and set(got) <= truth and len(set(got)) >= 0.99 * len(truth)
    classes = {r.record_id: r.class_id for r in near_dup.near_classes(table(rows)).collect()}
    assert all(classes[a] == classes[b] for a, b in got)
    assert near_dup.near_pairs(table(rows).limit(0)).count() == 0


def test_crowded_class(table):
    """A class far larger than any crowd bound loses no link."""
    base = prose(12, 3)
    rows = [(i, base + f"补充说明第{i}条" + "。") for i in range(130)]
    assert near_dup.near_pairs(table(rows)).count() == 130 * 129 // 2


def test_crowded_short_notices(table):
    """Short notices with scattered edits, all of one class, keep their links without any long equal passage."""
    r = random.Random(11)
    base = prose(9, 77)[:200]
    rows = []
    for i in range(300):
        t = list(base)
        for k in r.sample(range(200), 3):
            t[k] = chr(0x5000 + r.randrange(4000))
        rows.append((i, "".join(t)))
    truth = brute_pairs(rows)
    got = set(map(tuple, near_dup.near_pairs(table(rows)).collect()))
    assert len(truth) > 40_000 and got <= truth and len(got) >= 0.98 * len(truth)


def test_size_changes_no_pair(table):
    """A pair that is found among few texts is found among many that share its passage."""
    r = random.Random(8)
    signs = lambda n: "".join(chr(0x5000 + r.randrange(4000)) for _ in range(n))
    passage = signs(300)
    rows = [(i, passage + signs(95)) for i in range(300)]
    few, many = (set(map(tuple, near_dup.near_pairs(table(x)).collect())) for x in (rows[:30], rows))
    assert len(few) >= 300 and {(a, b) for a, b in many if b < 30} == few


def test_p6_found_asks_for_the_union(spark, tmp_path):
    """Sequences in both against those in at least one of the two: a text within a longer one is no case by itself."""
    r = random.Random(5)
    rows = []
    for k in range(40):
        t = list(prose(9, k)[:300])
        rows += [(100 * k, "".join(t)), (100 * k + 1, "".join(t[:150])), (100 * k + 2, "".join(t[:225]))]
        for n in range(1, 12):
            for j in r.sample(range(len(t)), n):
                t[j] = chr(0x5000 + r.randrange(4000))
            rows.append((100 * k + 10 + n, "".join(t)))
    spark.createDataFrame(rows, "record_id bigint, text string").write.parquet(f"{tmp_path}/pretrain.parquet")
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in rows}
    truth = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    got = sorted(map(tuple, queries.p6_found(spark, str(tmp_path)).collect()))
    assert len(got) == len(set(got)) and set(got) <= truth and len(got) >= 0.99 * len(truth)
    assert (0, 1) not in got  # half of a text, wholly within it
    classes = {x.record_id: x.class_id for x in queries.p6_classes(spark, str(tmp_path)).collect()}
    assert set(classes) == {i for p in got for i in p} and all(classes[a] == classes[b] for a, b in got)


def test_pigeonring():
    full, few = np.tile(np.uint64(2**64 - 1), (1, 8)), np.tile(np.uint64(0xFFFF), (1, 8))
    assert near_dup.likely(full, full, 0.7)[0] and near_dup.likely(few, few & ~np.uint64(0x1F), 0.7)[0]
    gone = few.copy()
    gone[0, :4] = 0xFFFF0000  # four of eight boxes differ wholly, four not at all: no chain around the ring keeps within
    assert not near_dup.likely(few, gone, 0.7)[0]
    assert not near_dup.likely(few, few & ~np.uint64(0x3FF) | np.uint64(0x3FF0000), 0.7)[0]  # every box beyond its budget


def test_chains():
    """Texts meet in two boxes without a difference, and the further boxes of a chain are told apart."""
    rng = np.random.default_rng(3)
    ring = rng.integers(0, 2**63, (2, 32)).astype(np.uint64)
    ring[1, 5:8] = ring[0, 5:8]
    key, more = near_dup.chains(ring)
    assert np.flatnonzero(key[0] == key[1]).tolist() == [5, 6]
    assert (more[0, 5] >> np.uint64(48)) == (more[1, 5] >> np.uint64(48)) and more[0, 5] != more[1, 5]


def test_hot_chains_are_spread(table, monkeypatch):
    """Chains beyond any bound are divided into blocks whose pairs are all looked at, once each way."""
    monkeypatch.setattr(near_dup, "HOT", 32)
    monkeypatch.setattr(near_dup, "HOT_SHARE", 10**9)
    base = prose(12, 3)
    rows = [(i, base + f"补充说明第{i}条。") for i in range(200)]
    assert near_dup.near_pairs(table(rows)).count() == 200 * 199 // 2


# --- 7 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,kind,value",
    [
        ("请联系 a.b_c1＠box.example 处理", "email", "a.b_c1＠box.example"), ("x-y (at) mail.test。", "email", "x-y (at) mail.test"), ("电话：138-0000-1234，", "phone", "138-0000-1234"),
        ("电话１８００００００１２３转12登记", "phone", "１８００００００１２３转12"), ("（0521）55505673", "phone", "（0521）55505673"), ("call +44 20 7946 0306.", "phone", "+44 20 7946 0306"),
        ("证件号码为 990322-19890515-351X，", "id_number", "990322-19890515-351X"), ("寄至禾洲市北塘镇青石路12号3栋101室，", "address", "禾洲市北塘镇青石路12号3栋101室"),
        ("lives at 12 Alder Road, Port Hessle. A", "address", "12 Alder Road, Port Hessle"), ("电话138-00\n00-1234，", "phone", "138-00\n00-1234"),
    ],
)
def test_certain_forms(text, kind, value):
    m = personal.Model({}, set(), set(), set(), set(), set(), set())
    assert [(k, text[a:b]) for a, b, k in m.find(text)] == [(kind, value)]


@pytest.mark.parametrize("text", ["接口参数 user@955117 为占位符", "受理流水号67423088953088956742", "统一代码9130889500MA6742", "工地位于沿河路段，桩号K14+758", "预算8255.13万元", ""])
def test_no_person(text):
    assert personal.Model({}, set(), set(), set(), set(), set(), set()).find(text) == []


def test_bootstrapped_names(table):
    r = random.Random(2)
    people = ["".join((r.choice("岑窦邬茅蔺闻柯阙"), *r.sample("屿峤朔棠榆汀漪澍煦珩砚禾", r.choice((1, 2))))) for _ in range(240)]
    rows = [(i, f"{prose(1, i)}联系人：{p}，联系电话：138-0000-{1000 + i}。") if i % 3 else (i, f"经核对，{p}的证件号码为 {990000 + i}19890515351{i % 10}，住址为禾洲市北塘镇青石路{i + 1}号。") for i, p in enumerate(people)]
    rows += [(500 + i, f"{prose(1, i)}\n经办：{p}") for i, p in enumerate(people[:40])] + [(900, None), (901, "")]
    df = table(rows)
    got = {(x.record_id, x.kind, x.value) for x in personal.find_personal(df).collect()}
    found = sum((i, "name", p) in got for i, p in enumerate(people))
    assert found >= 0.95 * len(people) and sum((500 + i, "name", p) in got for i, p in enumerate(people[:40])) >= 36
    text = {x.record_id: x.text for x in personal.mask_personal(df).collect()}
    assert "[PHONE]" in text[1] and "[NAME]" in text[1] and text[900] is None
    assert personal.find_personal(df.limit(0)).count() == 0


def test_discovered_numbers(table):
    """Numbers of a form that no seed has are found where they stand beside names as seeds do."""
    r = random.Random(4)
    people = [f"{r.choice(('Orla', 'Colm', 'Neva', 'Ilko', 'Tamsin', 'Maeva'))} {r.choice('ABC')}. {r.choice(('Dunmarsh', 'Venshaw', 'Quenby', 'Tolbrook', 'Osterwick'))}" for _ in range(120)]
    kinds = ("The form was signed by {p} (ID 900-{a}-{b}) today.", "Please contact {p} at box{a}@mail.test for files.", "The inventor, {p}, lives at {a} Alder Road, Port Hessle.")
    rows = [(i, kinds[i % 3].format(p=p, a=10 + i % 80, b=1000 + i)) for i, p in enumerate(people)]
    rows += [(500 + i, f"Open items are listed in file 900-{10 + i}-{2000 + i} of the office.") for i in range(30)]
    got = {(x.record_id, x.kind, x.value) for x in personal.find_personal(table(rows)).collect()}
    assert sum(k == "id_number" for _, k, _ in got) == 40 and not any(i >= 500 for i, k, _ in got if k == "id_number")
    assert sum((i, "name", p) in got for i, p in enumerate(people)) >= 75


def test_all_number_contexts_kept(table):
    """Every context that names prove is kept with its shapes, however many there are."""
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(3)) + "code" for n in range(personal.MAX_PATTERNS + 100)]
    text = lambda i: "\n".join(f"Orla Venshaw, {w} {10 + i}-{20000 + n}, as signed." for n, w in enumerate(words))
    m = personal._contexts(personal.Model({}, set(), set(), {"Orla"}, set(), set(), set()), table([(i, text(i)) for i in range(6)]).select("text"))
    assert {k[0].strip() for k in m.numbers} == set(words) and all(v == {"00-00000"} for v in m.numbers.values())


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    r = random.Random(3)
    sizes = spark.createDataFrame([(i, r.choice((0, 17, 130, 511, r.randint(1, 900)))) for i in range(800)] + [(9001, 5000)], "doc_id bigint, tokens bigint")
    for caps in ([512], [512, 1024]):
        rows = packing.pack(sizes, caps, "x").collect()
        assert sum(x.tokens for x in rows) == sum(x.tokens for x in sizes.collect())
        boxes, docs = {}, {}
        for x in rows:
            docs.setdefault(x.doc_id, []).append(x)
            if x.container_id is not None:
                boxes.setdefault(x.container_id, []).append(x)
            assert (x.container_id is None) == (x.tokens == 0)
        assert all(sum(x.tokens for x in b) <= b[0].capacity_tokens and b[0].capacity_tokens in caps and len({x.capacity_tokens for x in b}) == 1 for b in boxes.values())
        assert all(len(p) == 1 for d, p in docs.items() if sum(x.tokens for x in p) <= max(caps))
        assert sum(x.tokens for x in rows) / sum(b[0].capacity_tokens for b in boxes.values()) > 0.97
    assert packing.pack(sizes.limit(0), [512], "x").count() == 0


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files here")
def test_tokens_round_trip():
    enc = packing.encoder(packing.TOKENIZER)
    t = prose(3, 1) + " plain <|endoftext|> text\n\n é"
    assert enc.decode(enc.encode_ordinary(t)) == t


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    alphabet = "abcdefghij"
    items = ["".join(rng.choices(alphabet, k=n)) for n in (59, 60, 90, 300, 300)] + ["", None]
    docs = []
    for k in range(60):
        x = "".join(rng.choices(alphabet, k=rng.randint(0, 400)))
        it = items[k % 5]
        n = rng.choice((40, 59, 60, 61, 120))
        s = rng.randint(0, max(0, len(it) - n))
        docs.append((k, x + " ".join(it[s : s + n].upper()) + "，" + x))
    docs += [(100, None), (101, ""), (102, "x" * (PIECE + 5) + items[3]), docs[0]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")

    def plain(t):
        return "".join(c for c in (t or "").lower() if unicodedata.category(c)[0] in "LN")

    truth = {(k, q) for k, t in docs for q, it in enumerate(items) for x in [plain(t)] for y in [plain(it)] if any(y[s : s + 60] in x for s in range(len(y) - 59))}
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, i).collect()} == truth
    # too many items for one index: the same rows by a shuffle of fingerprints
    few, many = (sorted(map(tuple, leakage.find_leaks(d, i, index_chars=n).collect())) for n in (10**6, 0))
    assert few == many
    assert leakage.find_leaks(d.limit(0), i).count() == 0 and leakage.find_leaks(d, i.limit(0)).count() == 0


def test_windows():
    g = np.random.default_rng(0)
    h = g.integers(0, 1000, 300).astype(np.uint64)
    assert all(window_min(h, w).tolist() == [int(h[k : k + w].min()) for k in range(301 - w)] for w in (1, 2, 5, 41, 300))
    a = reduced("ＡbＣ一二 3!")
    assert "".join(map(chr, a)) == "abc一二3" and len(gram_hashes(a, 9)) == 0


# --- 10 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,want",
    [
        ("甲方到场。乙方签字！何时完工？", ["甲方到场。", "乙方签字！", "何时完工？"]),
        ("科长说：“何时完工？最迟明日。”乙方签字。", ["科长说：“何时完工？最迟明日。”", "乙方签字。"]),
        ("记录所写“不合格。复检！”，经核实。", ["记录所写“不合格。复检！”，经核实。"]),
        ("提交样品（规格见表9。以封样为准）并签收。", ["提交样品（规格见表9。以封样为准）并签收。"]),
        ("The gap is 4.32 mm, i.e. small. The end came.", ["The gap is 4.32 mm, i.e. small.", "The end came."]),
        ("पहला वाक्य है। दूसरा वाक्य है?", ["पहला वाक्य है।", "दूसरा वाक्य है?"]),
        ("لماذا؟ انتهى.", ["لماذا؟", "انتهى."]),
        ("  \n\n ", []),
        ("第一段没有句号\n\n第二段。", ["第一段没有句号", "第二段。"]),
    ],
)
def test_sentences(text, want):
    m = sentences.Model()
    for _ in range(5):
        m.learn("The gap is open. It is 3 mm, i.e. small, and closed. The door is i.e. shut.\n乙方签字。经核实后完成，经核实。")
    got = [text[a:b] for a, b in sentences.sentences(text, m)]
    assert got == want


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "甲方到场。乙方签字。"), (2, None), (3, ""), (1, "甲方到场。乙方签字。")], "doc_id bigint, text string")
    assert sorted(map(tuple, sentences.split_sentences(df).collect())) == [(1, 0, 5), (1, 0, 5), (1, 5, 10), (1, 5, 10)]
    assert sentences.split_sentences(df.limit(0)).count() == 0
