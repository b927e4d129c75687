"""Behaviour of patent cleaning as data: operation input, what must be in the result and what must not."""

import pytest

from corpusloom.operators import patent, segment

CN = "CN 102955986 A"
PROSE = "本发明公开了一种自动化的招投标方法，用于提高效率。"
# Forms of footers, numbers and fragments that cleaning is known for, some as they stand in published cases.
CASES = [
    ("garbled footer block", f"{PROSE}\n{CN}\n机明节\n1/3页\n后面的正文", ["后面的正文"], [CN, "机明节", "1/3页"]),
    ("clean footer block", f"{PROSE}\n{CN}\n说明书\n4/6页\n{PROSE}", [], [CN, "说明书", "4/6页"]),
    ("garbled number alone", f"{PROSE}\nNN 017 A\n{PROSE}", [], ["NN 017"]),
    ("two-line footer", f"{PROSE}\n全N 1999191 A\n{CN}", [], ["全N", CN]),
    ("inline number kept", f"如{CN}所述的方法包括如下步骤。", ["CN"], []),
    ("claims footer and page", "5. 根据权利要求4所述的方法。\n权利要求书\n2/2页\n6. 根据权利要求1所述的方法。", ["6. 根据权利要求1"], ["权利要求书", "2/2页"]),
    ("claims footer, number, page", f"8. 如权利要求1。\n权利要求书\n{CN}\n2/2页\n9. 如权利要求2所述。", ["9. 如权利要求2"], ["权利要求书"]),
    ("join in a word", "一种方法，其包\n括如下步骤。", ["包括"], []),
    ("join Chinese", "涉及招\n标方法。", ["招标方法"], ["招\n标方法"]),
    ("header not joined", "摘要内容完毕。\n技术领域\n本发明涉及招标。", ["技术领域"], []),
    ("numbers not joined", "正文\n[0001] 第一段\n[0002] 第二段", ["[0001]", "[0002]"], []),
    ("sentence end not joined", "完成登录。\n注册用户。", [], ["。注册"]),
    ("number attached", "[0055]\n本实施例说明。", ["[0055] 本实施例"], []),
    ("partial number", "完成。\nN1110700\n继续。", [], ["N1110700"]),
    ("serial", "前面\n1101-194T20200528\n后面", [], ["1101-194T20200528"]),
    ("short content kept", "[0052] 图1 示意图", ["图1"], []),
    ("three-line footer", f"{PROSE}\n{CN}\n玩明书\n2/6页\n正文后面继续。", ["正文后"], ["玩明书", CN, "2/6页"]),
    ("claims header, number, page, content", f"摘要内容完毕。\n权利要求书\n{CN}\n1/1页\n1. 一种招投标系统，其特征在于包括数据库。", ["1. 一种招投标系统"], []),
    ("several numbers attached", "[0055]\n第一段说明。\n[0056]\n第二段说明。", ["[0055] 第一段", "[0056] 第二段"], []),
    ("footers not joined", f"前一段没有句号的正文\n{CN}\n说明书\n4/6页\n后一段的正文。", ["前一段没有句号的正文", "后一段的正文。"], ["说明书", CN]),
    ("punctuation boundary", "第一句话完毕。\n第二句话完毕。", ["第一句话完毕。\n第二句话完毕。"], []),
    ("section integrity", f"具体实施方式\n[0002] 第一段内容。\n{CN}\n说明书\n4/6页\n[0003] 第二段内容。", ["具体实施方式", "[0002]", "[0003]"], ["4/6页"]),
    ("blend", f"[0037] 一段文字。\n况明书\n{CN}\n7/7页\n[0038] 又一段。", ["[0037]", "[0038]"], ["况明书"]),
]


@pytest.mark.parametrize("name,text,there,gone", CASES, ids=[c[0] for c in CASES])
def test_clean(column, name, text, there, gone):
    (out,) = column(patent.clean, text)
    assert all(x in out for x in there) and not any(x in out for x in gone), out


@pytest.mark.parametrize("variant", ["机明节", "玩明书", "讥明节", "况明书"])
def test_garbled_variants(column, variant):
    assert variant not in column(patent.clean, f"{PROSE}\n{variant}\n{CN}\n{PROSE}")[0]


def test_edge_cases(column):
    empty, noise, null = column(patent.clean, "", "X\nNN 017 A\nN1110700\n机明节\n1/3页", None)
    assert empty == "" and null is None
    assert len(noise) < 20


def test_single_letter_line(column):
    assert "X" not in column(patent.clean, "(19) 国家知识产权局\nX\n(12) 发明专利")[0].split("\n")


def test_segments_bounds(column):
    text = "\n".join(f"[{i:04d}] " + "招标文件的生成方法包括数据采集与校验步骤。" * 3 for i in range(1, 30))
    (out,) = column(lambda c: segment.segment_patent(patent.clean(c), 120, 2000), text)
    assert out and all(120 <= len(x) <= 2000 for x in out)


def test_merge_tail_and_oversize(column):
    run = lambda *g: column(lambda c: segment.merge_groups(segment.F.split(c, r"\|"), 3, 6, lambda x: segment.pack_sentences(x, 6)), "|".join(g))[0]
    assert run("ab", "cd") == ["ab\ncd"]
    assert run("abcd", "x") == ["abcd\nx"]
    assert run("abcd", "efgh") == ["abcd", "efgh"]
    assert run("一二三。四五六七。", "z") == ["一二三。", "四五六七。\nz"]
    assert run("x") == ["x"]


# One literal line or stretch per stage: text, what it becomes. None stands between the two others by chance.
STAGES = {
    "page_separator": ("甲\f乙", "甲\n\n乙"),
    "company_line": ("甲\n 江苏某某（集团）有限公司 \n乙有限公司说明", "甲\n\n乙有限公司说明"),
    "person_names": ("前\n张三 李四 王五一\n\n李四说。", "前\n\n李四说。"),
    "page_number": ("12\n１２ \n12a", "\n\n12a"),
    "cn_page_number": ("第 3 页\n第3页说明", "\n第3页说明"),
    "bibliographic": ("(21) 申请号 2012。\n申请人为甲。乙", "\n申请人为甲。乙"),
    "bibliographic_header": ("(19) 国家知识产权局\n(1) 甲", "\n(1) 甲"),
    "ipc_class": ("G06Q 30/08 (2012.01)\nG06 30/08", "\nG06 30/08"),
    "cn_id": ("CN 102955986 A\nCN 102955986 A 号", "\nCN 102955986 A 号"),
    "garbled_cn": ("NN 017 A\n全N 1999 A\nNN A", "\n\nNN A"),
    "garbage": ("。-\n甲\n＝=+|\n。。x", "。-\n甲\n\n。。x"),
    "isolated_noise": ("X\n1101-194\n1101-1945678AB\nN1110700\nXY", "\n1101-194\n\n\nXY"),
    "garbled_line": ("、、12 34\n12/34x", "\n12/34x"),
    "page_counts": ("见权利要求书 2 页 说明书 6 页 附图 3 页。", "见。"),
    "agent": ("甲 11 代理人张某，余", "甲 "),
    "boilerplate": ("以上所述仅为本发明的较佳实施例，不限。余\n 以上所述仅为本发明的较佳实施例。", "余\n 以上所述仅为本发明的较佳实施例。"),
    "generic_line": ("权利要求书1页说明书5页\n权利要求书1页说明书5页等", "\n权利要求书1页说明书5页等"),
}


@pytest.mark.parametrize("stage", [*patent.BEFORE_JOIN, *patent.LINE_STAGES], ids=lambda s: s[0])
def test_stage(column, stage):
    text, want = STAGES[stage[0]]
    assert column(lambda c: patent.apply_stage(c, stage), text)[0] == want


def test_line_functions(column):
    assert column(patent.attach_numbers, "[0001]\n\n甲\n[0002]")[0] == "[0001] 甲\n[0002]"
    assert column(patent.remove_fragments, "x\n甲\nN123456\n2020-AB\n甲乙")[0] == "甲乙"
    assert column(patent.remove_footer_runs, f"甲\n权利要求书\n{CN}\n1/2页\n说明书\n乙\n{CN}\n丙")[0] == f"甲\n乙\n{CN}\n丙"
    assert column(patent.remove_claims_footers, f"甲\n权利要求书\n2/2页\n乙\n权利要求书\n{CN}\n3/3页\n权利要求书\n丙")[0] == "甲\n乙\n权利要求书\n丙"
    assert column(patent.normalise_blanks, "甲  乙\n\n\n \t丙\t ")[0] == "甲 乙\n丙"
    assert column(lambda c: patent.is_footer_line(c).cast("string"), "说 明 书", "4/6页", "说明") == ["true", "true", "false"]
    assert column(lambda c: patent.is_section_boundary(c).cast("string"), "技术领域", "[0001] 甲", "12、甲", "三、", "技术领域的") == ["true"] * 4 + ["false"]


def test_sections_and_paragraphs(column):
    assert column(segment.split_sections, f"前言\n技术领域：\n甲\n权利要求书\n{CN}\n1/2页\n1. 乙\n摘要")[0] == ["前言", "技术领域\n甲", "权利要求书\n1. 乙", "摘要"]
    assert column(segment.split_paragraphs, "甲\n[0001] 乙\n[0002] 丙", "甲\n1、乙\n平台、丙", "甲\n\n乙", "甲\n乙") == [["甲", "[0001] 乙", "[0002] 丙"], ["甲", "1、乙", "平台、丙"], ["甲", "乙"], ["甲\n乙"]]
    assert column(lambda c: segment.split_long(c, 6), "甲一二。三四\n五六七\n[0001] 八")[0] == ["甲一二。", "三四\n五六七", "[0001] 八"]
    assert column(lambda c: segment.pack_sentences(c, 6), "一二。三四。五六七八九十。")[0] == ["一二。三四。", "五六七八九十。"]
    assert column(lambda c: segment.split_long_regulation(c, 6), "一二。三四。五\n\n六七")[0] == ["一二。三四。", "五", "六七"]


def _records(spark, text):
    from corpusloom.plans import pipelines

    return [r.text for r in pipelines.records(spark.createDataFrame([(1, text)], "id int, text string"), "patent").orderBy("seg_no").collect()]


def test_records(spark):
    long = "本发明提供一种招投标信息处理的方法，能够自动采集并校验投标文件中的各项数据，提高评审的效率。" * 4
    got = _records(spark, f"发明内容\n{long}\n权利要求书\n{CN}\n1/1页\n1. {long}")
    assert got and "1." in "".join(got)
    assert _records(spark, "只有一句短话。") == [] and _records(spark, "技术领域\n短话。") == [] and _records(spark, "") == []
    assert _records(spark, "X\nNN 017 A\nN1110700\n机明节\n1/3页") == []
