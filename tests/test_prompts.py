"""Messages for a model: recorded calls and what they hold, JSON of candidates, odd rows."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import prompts, sounds

CALL = "call_id long, user_input string, state string, matched_index int, last_unmatched_address string, last_unmatched_fragment string, similar_no_match_count int, address_list array<string>"
# Recorded calls (what was said, what was left open, the fragment, candidates) and what they are built into.
FU = ["福州市岳峰镇保利香槟国际东区三号楼1201", "福州市岳峰镇保利香槟国际东区三号楼1200"]
TAI = ["移机费50元山西太原市尖草坪区卧虎山路柏翠苑1号楼5单元202室", "山西太原市尖草坪区卧虎山路柏翠苑4号楼2单元102室", "移机费50元山西太原市尖草坪区江阳商业街江阳化工厂100号楼1单元302室"]
GU = ["福建省福州市鼓楼区中山路保利香槟国际八号楼2103", "福建省福州市鼓楼区中山路保利香槟国际八号楼2101"]
SHI = ["福建漳州云霄县莆美镇世安新城方景小区352", "福建漳州云霄县南阳路福宁小区123"]
CALLS = [
    (("保利香槟", "三号楼1201", None, FU), "保利香槟", "三号楼1201保利香槟", ["User: 保利香槟", "last_unmatched_address=三号楼1201", "本轮 User 只表示 clean_user_input"], []),
    (("保利香槟", "三号楼1201东区", None, FU), "保利香槟", "三号楼1201东区保利香槟", ["last_unmatched_address=三号楼1201东区"], ["1201栋区"]),
    (("保利香槟", "中山路", None, ["中山路3号楼2101", FU[0]]), "保利香槟", "保利香槟", [], ["User: 中山路保利香槟"]),
    (("普美镇", "1201", None, ["福建漳州云霄县莆美镇福湾小区8号楼1201", "福建漳州云霄县普美镇福湾小区8号楼1201"]), "普美镇", "普美镇", [], ["1201莆美镇"]),
    (("我住在福州市岳峰镇保利香槟国际", "", None, FU), "福州市岳峰镇保利香槟国际", "福州市岳峰镇保利香槟国际", ["\nUser: 福州市岳峰镇保利香槟国际"], ["我住在", "\nUser: 福州市岳峰镇保利香槟国际东区"]),
    (("麻烦帮我查一下福州市岳峰镇保利香槟国际", "", None, FU), "福州市岳峰镇保利香槟国际", "福州市岳峰镇保利香槟国际", [], ["麻烦"]),
    (("麻烦查一下保利香槟3号楼1200", "", None, FU), "保利香槟3号楼1200", "保利香槟3号楼1200", ["\nUser: 保利香槟3号楼1200"], ["麻烦"]),
    (("3好楼", "中山路:", None, ["中山路3号楼2101", "中山路3号楼2102"]), "3好楼", "中山路3号楼", [], []),
    (("芳景小区", "世安新城", None, SHI), "芳景小区", "世安新城方景小区", ["User: 芳景小区"], []),
    (("长山农场树东村", "云霄县", None, ["福建漳州云霄县莆美镇大埔村352", "福建漳州云霄县常山农场树洞村123"]), "长山农场树东村", "云霄县常山农场树洞村", [], []),
    (("保留香槟", "三号楼1201", "三号楼1201", FU), "保留香槟", "保留香槟", ["User: 保留香槟", "保利香槟", "留(liu)≠利(li)", "不同音节"], ["根据拼音(多音字)发现用户片段与候选片段相近: 保留香槟~保利香槟"]),
    (("保利香槟", "福州市鼓楼区", "福州市鼓楼区", GU), "保利香槟", "福州市鼓楼区保利香槟", ["clean_user_input=保利香槟", "last_matched_address_fragment=福州市鼓楼区", "candidate_combined_user_scope_if_supplement=福州市鼓楼区保利香槟", "User: 保利香槟", "请先判断 clean_user_input", "不能只输出 clean_user_input 本轮片段"], ["User: 福州市鼓楼区保利香槟"]),
    (("1201", "A120", None, ["A1201", "A1200"]), "1201", "A1201", ["User: 1201"], ["A1201201"]),
    (("1201", FU[0][:-1], None, FU), "1201", FU[0], ["User: 1201"], ["1201201"]),
    (("一百楼一单元三零二", "", None, TAI), "一百楼一单元三零二", "一百楼一单元三零二", ["User: 一百楼一单元三零二", "clean_user_input: 一百楼一单元三零二"], ["User: 楼一单元三零二"]),
    (("江阳化工厂", "一百楼一单元三零二", None, TAI), "江阳化工厂", "一百楼一单元三零二江阳化工厂", ["User: 江阳化工厂", "last_unmatched_address=一百楼一单元三零二", "clean_user_input: 江阳化工厂"], ["一百楼1单元302"]),
    (("江洋小区", "一百楼一单元三零二", "100号楼1单元302室", TAI[2:]), "江洋小区", "江阳小区", ["last_unmatched_address=100号楼1单元302室", "last_matched_address_fragment=100号楼1单元302室"], ["last_unmatched_address=一百楼一单元三零二"]),
    (("江阳小区", "一百楼一单元三零二江阳化工厂", "一百楼一单元三零二江阳化工厂", TAI), "江阳小区", "江阳小区", ["本轮地点主体校验", "candidate_supports_current_anchor=false", "matched_address_fragment 应按提示词中无候选支持或上一轮结果的规则处理"], []),
    (("汤池镇百花小区9栋1109", "", None, ["安徽省合肥市庐江县汤池镇百花小区9栋1109"]), "汤池镇百花小区9栋1109", "汤池镇百花小区9栋1109", ['"clean_address": "安徽省合肥市庐江县汤池镇百花小区9栋1109"', '"base_address": "安徽省合肥市庐江县汤池镇百花小区"'], []),
]


@pytest.fixture(scope="module")
def found(spark):
    chars = {c for call, *_ in CALLS for c in "".join([call[0], *call[3]])}
    readings = sounds.icu_readings(spark)
    mine = readings.where(readings.char.isin(sorted(chars))).union(spark.createDataFrame([("长", "chang")], "char string, syllable string"))
    heard = spark.createDataFrame(sounds.sounding(mine).collect(), "char string, syllables array<string>, classes array<string>")
    df = spark.createDataFrame([(i, said, "matching", -1, before, fragment, 1, known) for i, ((said, before, fragment, known), *_) in enumerate(CALLS)], CALL)
    return {r.call_id: r for r in prompts.built(df, heard).collect()}


@pytest.mark.parametrize("i", range(len(CALLS)))
def test_recorded_call(found, i):
    _, clean, effective, holds, lacks = CALLS[i]
    r = found[i]
    assert (r.built.clean_user_input, r.built.llm_user_input, r.built.effective_match_input) == (clean, clean, effective)
    assert [x for x in holds if x not in r.built.user_message] == [] and [x for x in lacks if x in r.built.user_message] == []
    assert r.built.possible_merged_input == (effective if len(effective) > len(clean) else "")


def test_candidates_are_json(spark):
    known = ['a"b\\c', "x\n1号楼2室", None, "中山路3号楼2101", "建国路88号现代城5号楼1单元101室", "香江悦府1幢1层401", "楚天传媒大厦B座2004室"]
    r = spark.createDataFrame([(known,)], "k array<string>").select(prompts.candidates_info(F.col("k")).alias("i")).select("i", prompts.candidates_json(F.col("i")).alias("j")).first()
    assert json.loads(r.j) == [x.asDict() for x in r.i]
    assert [x.base_address for x in r.i] == ['a"b\\c', "x\n", "", "中山路", "建国路88号现代城", "香江悦府", "楚天传媒大厦"]


def test_odd_rows(spark):
    """Nulls throughout, a closed context, no candidates; other columns and the order of columns stay."""
    heard = sounds.sounding(spark.createDataFrame([], "char string, syllable string"))
    rows = [(1, None, None, None, None, None, None, None), (2, "香槟", "matching", -1, "__NO_MERGE__:保利香槟", None, 0, ["保利香槟"]), (None, "香槟", None, None, "保利", None, None, ["保利香槟"])]
    df = spark.createDataFrame(rows, CALL)
    out = prompts.built(df.selectExpr("*", "7 AS fragment"), heard)
    assert out.columns == [*df.columns, "fragment", "built", "candidates_info", "supported", "misses"]
    got = {r.call_id: (r.built.effective_match_input, r.supported, r.fragment) for r in out.collect()}
    assert got == {1: ("", False, 7), 2: ("香槟", True, 7), None: ("保利香槟", True, 7)}
