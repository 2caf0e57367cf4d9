"""Correction of homophones and cleaning of spoken addresses: recorded examples, and brute force on random texts."""

import random
import re

import pytest

from lectern.operators import prompts, sounds

CALLS = "call_id long, spoken string, address_list array<string>"
# Recorded examples of what callers said, their candidates and what is expected.
YUN = ["福建漳州云霄县莆美镇大埔村352", "福建漳州云霄县常山农场树洞村123"]
SHI = ["福建漳州云霄县莆美镇世安新城方景小区352", "福建漳州云霄县南阳路福宁小区123"]
FU = ["福州市岳峰镇保利香槟国际东区三号楼1201", "福州市岳峰镇保利香槟国际东区三号楼1200"]
ROAD = ["公园路桃园华府30号楼"]
PLANT = ["移机费50元山西太原市尖草坪区江阳商业街江阳化工厂100号楼1单元302室"]
MEANT = [
    ("云效县", YUN, "云霄县"),
    ("云晓现", YUN, "云霄县"),
    ("长山农场树东村", YUN, "常山农场树洞村"),
    ("3好楼", ["中山路3号楼2101", "中山路3号楼2102"], "3号楼"),
    ("四安新城", SHI, "世安新城"),
    ("欢景小区", SHI, "方景小区"),
    ("芳景小区", SHI, "方景小区"),
    ("参海民筑3号楼", ["福建漳州云霄县莆美镇沧海名著3号楼352", "福建漳州云霄县南阳路福宁小区123"], "沧海名著3号楼"),
    ("1202普美镇", ["福建漳州云霄县莆美镇福湾小区8号楼1202", "福建漳州云霄县常山农场树洞村123"], "1202莆美镇"),
    ("三号楼1201栋区保利香槟", FU, "三号楼1201东区保利香槟"),
    ("保留香槟", FU, "保留香槟"),
    ("普美镇", ["福建漳州云霄县莆美镇福湾小区8号楼1201", "福建漳州云霄县普美镇福湾小区8号楼1201"], "普美镇"),
    ("江阳小区", PLANT, "江阳小区"),
    ("一百楼一单元三零二", PLANT, "一百楼一单元三零二"),
]
CLEAN = [
    ("我住在福州市岳峰镇保利香槟国际", FU, "福州市岳峰镇保利香槟国际"),
    ("麻烦帮我查一下福州市岳峰镇保利香槟国际", FU, "福州市岳峰镇保利香槟国际"),
    ("麻烦查一下保利香槟3号楼1200", FU, "保利香槟3号楼1200"),
    ("真爱桃园华府", ROAD, "桃园华府"),
    ("宽地阔的公园路", ROAD, "公园路"),
    ("乱七八糟公园路", ROAD, "公园路"),
    ("100栋302", PLANT, "100栋302"),
    ("桃园华府北门", ROAD, "桃园华府北门"),
    ("桃园华府的公园路", ROAD, "桃园华府的公园路"),
    ("北门的公园路", ROAD, "北门的公园路"),
    ("一百楼一单元三零二", PLANT, "一百楼一单元三零二"),
    ("保留香槟", FU, "保留香槟"),
    ("我住在大同区", FU, "大同区"),
]


@pytest.fixture(scope="module")
def heard(spark):
    """ICU's readings, which know one for each character, with the other one of 长."""
    readings = sounds.icu_readings(spark)
    chars = {c for spoken, known, _ in MEANT + CLEAN for c in spoken + "".join(known)}
    mine = readings.where(readings.char.isin(sorted(chars))).union(spark.createDataFrame([("长", "chang")], "char string, syllable string"))
    return spark.createDataFrame(sounds.sounding(mine).collect(), "char string, syllables array<string>, classes array<string>")


def test_icu_readings(spark):
    found = dict(sounds.icu_readings(spark).where("char IN ('霄', '效', '利', '留', '世')").collect())
    assert found == {"霄": "xiao", "效": "xiao", "利": "li", "留": "liu", "世": "shi"}


def test_recorded_corrections(spark, heard):
    df = spark.createDataFrame([(i, a, k) for i, (a, k, _) in enumerate(MEANT)], CALLS)
    got = {r.call_id: r for r in sounds.corrected(df, heard).collect()}
    assert [got[i].corrected for i in range(len(MEANT))] == [x for _, _, x in MEANT]
    assert [i for i in got if got[i].ambiguous] == [11]
    assert [tuple(x) for x in got[8].changes] == [(4, "普", "莆")]


def test_recorded_cleaning(spark, heard):
    df = spark.createDataFrame([(i, a, k) for i, (a, k, _) in enumerate(CLEAN)], CALLS)
    assert [r.clean for r in sounds.cleaned(df, heard).orderBy("call_id").collect()] == [x for _, _, x in CLEAN]


def test_classes_of_a_graph(spark):
    pairs = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), ("z", "z")], "a string, b string")
    assert dict(sounds.classes(pairs).collect()) == dict(a="a", b="a", c="a", d="a", x="x", y="x", z="z")
    rules = sounds.classes(sounds.confusable(spark.createDataFrame([(None, x) for x in ("si", "shi", "huan", "fang", "min", "ming", "can", "cang", "liu", "li", "hu", "fu", "zhuang")], "char string, syllable string")))
    by = dict(rules.collect())
    assert by["si"] == by["shi"] and by["huan"] == by["fang"] and by["min"] == by["ming"] and by["can"] == by["cang"]
    assert by["liu"] != by["li"] and by["hu"] != by["fu"]


def test_odd_rows(spark, heard):
    """Nulls, empty texts and lists, a text beyond the basic plane, no readings at all; other columns stay."""
    rows = [(1, None, YUN), (2, "", YUN), (3, "云效县", None), (4, "云效县", []), (5, "😀云效县", ["a😀云霄县", None, ""]), (None, "云效县", YUN)]
    df = spark.createDataFrame(rows, CALLS).selectExpr("*", "1 AS i", "2 AS kind")
    got = {r.call_id: (r.corrected, r.i, r.kind) for r in sounds.corrected(df, heard).collect()}
    assert got == {1: (None, 1, 2), 2: ("", 1, 2), 3: ("云效县", 1, 2), 4: ("云效县", 1, 2), 5: ("😀云霄县", 1, 2), None: ("云效县", 1, 2)}
    assert sounds.corrected(df.where("false"), heard).count() == 0
    none = spark.createDataFrame([], "char string, syllable string")
    assert {r.corrected for r in sounds.corrected(df.where("call_id = 5"), sounds.sounding(none)).collect()} == {"😀云效县"}
    assert {r.call_id: r.clean for r in sounds.cleaned(df, heard).collect()} == {1: None, 2: "", 3: "云效县", 4: "云效县", 5: "😀云效县", None: "云效县"}


def brute(spoken, known, syllables, classes):
    """The definition, pair by pair."""
    fold = lambda c: c.translate(str.maketrans(sounds.NUMERALS, sounds.FIGURES))

    def kind(a, b):
        if fold(a) == fold(b):
            return 0
        if syllables.get(a, set()) & syllables.get(b, set()):
            return 1
        return 2 if classes.get(a, set()) & classes.get(b, set()) else None

    found = []
    for text in known:
        for d in range(-len(text), len(spoken)):
            run = []
            for i in range(len(spoken) + 1):
                k = kind(spoken[i], text[i - d]) if i < len(spoken) and 0 <= i - d < len(text) else None
                if k is not None:
                    run.append((i, spoken[i] if k == 0 else text[i - d], k))
                elif run:
                    if any(x[2] == 0 for x in run) and len(run) >= sounds.LEAST[max(x[2] for x in run)]:
                        found.append(run)
                    run = []
    out = list(spoken)
    longest = {i: max(len(r) for r in found if any(x[0] == i for x in r)) for r in found for i, _, _ in r}
    forms = {}
    for r in found:
        for i, form, _ in r:
            if len(r) == longest[i]:
                forms.setdefault(i, set()).add(form)
    for r in found:
        if all(len(r) == longest[i] and len(forms[i]) == 1 for i, _, _ in r):
            for i, form, _ in r:
                out[i] = form
    return "".join(out), any(len(x) > 1 for x in forms.values())


def test_against_brute_force(spark):
    rng = random.Random(8)
    readings = [("a", "shi"), ("b", "si"), ("c", "shi"), ("d", "fang"), ("e", "huan"), ("e", "li"), ("f", "li"), ("三", "san"), ("g", "shan"), ("h", "lin")]
    table = sounds.sounding(spark.createDataFrame(readings, "char string, syllable string"))
    by = {r.char: (set(r.syllables), set(r.classes)) for r in table.collect()}
    assert by["a"][1] == by["b"][1] and by["d"][1] == {"fan"} and by["e"][1] == {"fan", "li"}
    word = lambda n: "".join(rng.choice("abcdefgh三3xy") for _ in range(n))
    rows = [(i, word(rng.randrange(9)), [word(rng.randrange(14)) for _ in range(rng.randrange(4))]) for i in range(400)]
    got = {r.call_id: (r.corrected, r.ambiguous) for r in sounds.corrected(spark.createDataFrame(rows, CALLS), table).collect()}
    want = {i: brute(a, k, {c: x for c, (x, _) in by.items()}, {c: x for c, (_, x) in by.items()}) for i, a, k in rows}
    assert got == want
    assert sum(got[i][0] != a for i, a, _ in rows) > 40 and any(x for _, x in got.values())


def test_introductions():
    assert [re.sub(sounds.INTRODUCTION, "", x) for x in ("你好我家住在A", "那个麻烦请查一下B", "保利")] == ["A", "B", "保利"]


def test_calls_are_not_broadcast(spark):
    """Only the table of readings is: the joins by the caller's key take no side to the driver, however small the calls are packed."""
    heard = sounds.sounding(spark.createDataFrame([("安", "an"), ("岸", "an")], "char string, syllable string"))
    calls = spark.createDataFrame([(1, "安", ["岸"])], "call_id long, spoken string, address_list array<string>")
    for found in (sounds.cleaned(calls, heard), sounds.corrected(calls, heard), prompts.near_misses(calls, heard)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        keyed = [line for line in plan.splitlines() if "Join" in line and ("key#" in line or "call_id#" in line)]
        assert keyed and all("SortMergeJoin" in line for line in keyed), keyed
