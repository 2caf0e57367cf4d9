"""Layout, numbering, names, model answers, addresses, sources and streams on literal inputs."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import address, assistant, layout, names, numbering, rsa
from lectern.sources import catalog, docx, files
from lectern.streaming import dialogue

TALK = """张敏：你好，我是张敏，今天跟你确认面试时间。
李雷：好的，我是李雷。
张敏：请把材料发给王芳老师。
Alice Chen: Hi all.
Bob Li: Thanks Alice, I am Bob Li and I will join the call too."""


def test_names(spark):
    df = spark.createDataFrame([(1, TALK)], "conv_id long, text string")
    got = {r.name: (r["count"], r.score, r.confidence, r.sources) for r in names.extract(df).collect()}
    assert got["张敏"] == (3, 13, "高", ["speaker", "self_intro"])
    assert got["李雷"] == (2, 9, "高", ["speaker", "self_intro"])
    assert got["Bob Li"] == (2, 9, "高", ["speaker", "english_self_intro"])
    assert got["Alice Chen"] == (1, 4, "低", ["speaker"])
    order = [r.name for r in names.ranked(names.extract(df)).collect()]
    assert order[0] == "张敏" and order.index("李雷") < order.index("Bob Li")
    assert names.totals(df).first().total_lines == 5


def test_layout_edges(spark):
    blocks = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0, " a  b ", 0), (1, 1, 2, 100.0, 100.0, 110.0, 110.0, "in", 0), (1, 1, 3, 0.0, 50.0, 10.0, 60.0, "edge", 0), (1, 1, 4, 0.0, 0.0, 1.0, 1.0, "no", 1)], "doc_id long, page int, seq long, x0 double, y0 double, x1 double, y1 double, text string, block_type int")
    boxes = spark.createDataFrame([(1, 1, 1, 95.0, 95.0, 200.0, 200.0, "|t|"), (1, 1, 2, 7.0, 50.0, 100.0, 60.0, "|u|")], "doc_id long, page int, table_number long, x0 double, y0 double, x1 double, y1 double, text string")
    kept = {r.seq for r in layout.outside_tables(layout.text_blocks(blocks), boxes).collect()}
    assert kept == {1}  # seq 3 overlaps by exactly 0.3
    images = spark.createDataFrame([(1, 1, s, x, 20.0, 30.0, 40.0, "PNG", 4, 5, 9) for s, x in ((1, 1.01), (2, 1.04), (3, 2.0))], "doc_id long, page int, seq long, x0 double, y0 double, x1 double, y1 double, ext string, width int, height int, size_bytes int")
    row = layout.merged(blocks, boxes, layout.distinct_images(images)).first()
    assert row.text == "a b\n\n[Image 1: format=png, size=4x5, bbox=(1.0,20.0,30.0,40.0)]\n\n[Image 2: format=png, size=4x5, bbox=(2.0,20.0,30.0,40.0)]\n\n|u|\n\n|t|"
    assert (row.table_count, row.image_count, row.text_block_count) == (2, 2, 3)


def test_assembled(spark):
    pages = spark.createDataFrame([(1, 1, "plain")], "doc_id long, page int, plain_text string")
    blocks = spark.createDataFrame([], "doc_id long, page int, seq long, x0 double, y0 double, x1 double, y1 double, text string, block_type int")
    boxes = spark.createDataFrame([], "doc_id long, page int, table_number long, x0 double, y0 double, x1 double, y1 double, text string")
    images = spark.createDataFrame([], "doc_id long, page int, seq long, x0 double, y0 double, x1 double, y1 double, ext string, width int, height int, size_bytes int, image_number int")
    row = layout.assembled(pages, blocks, boxes, images).first()
    assert (row.text, row.extraction_mode) == ("plain", "pymupdf_sorted_text")


def machine(rows):
    held, out = {}, []
    for k in rows:
        held[k] = held.get(k, 0) + 1
        held = {a: n for a, n in held.items() if a <= k}
        out.append(held[k])
    return out


def test_counters_equal_machine(spark):
    rng = random.Random(3)
    rows = [(d, p, 1, rng.randrange(4), 1) for d in range(30) for p in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "doc_id long, para_no long, num_id int, ilvl int, start int")
    for frame, value in ((numbering.values(df), lambda r: r.value), (numbering.counters(df), lambda r: r.counters[r.ilvl])):
        got = {(r.doc_id, r.para_no): value(r) for r in frame.collect()}
        for d in range(30):
            own = [r for r in rows if r[0] == d]
            assert [got[d, r[1]] for r in own] == machine([r[3] for r in own])


def test_templates_with_other_text(spark):
    rows = [(1, p, n, i, 1, "decimal", t, "x") for p, (n, i, t) in enumerate([(1, 0, "Part %1: %0 %"), (None, None, None), (1, 1, "(%2) of %1"), (1, 1, "a"), (1, 0, None), (1, None, "%9")])]
    df = spark.createDataFrame(rows, "doc_id long, para_no long, num_id int, ilvl int, start int, num_fmt string, lvl_text string, text string")
    levels = spark.createDataFrame([(1, 0, 1, "upperRoman"), (1, 1, 1, "lowerLetter")], "num_id int, ilvl int, start int, num_fmt string")
    got = [r.text for r in numbering.prefixed(df, levels).orderBy("para_no").collect()]
    assert got == ["Part I: %0 % x", "x", "(a) of I x", "a x", "II x", "1 x"]


def test_long_style_chain(spark):
    rows = [(str(i), str(i + 1), None, None) for i in range(70)] + [("70", None, 4, 1)]
    df = spark.createDataFrame(rows, "style_id string, based_on string, num_id int, ilvl int")
    assert {(r.num_id, r.ilvl) for r in numbering.resolved_styles(df).collect()} == {(4, 1)}


def test_style_cycle(spark):
    df = spark.createDataFrame([("a", "b", None, 2), ("b", "a", 7, None), ("c", "x", None, None)], "style_id string, based_on string, num_id int, ilvl int")
    assert {r.style_id: (r.num_id, r.ilvl) for r in numbering.resolved_styles(df).collect()} == {"a": (7, 2), "b": (7, 2), "c": (None, None)}


NUMBERING = """<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>
<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="0"/></w:num>"""


def test_docx():
    content = docx.build(["Title", "one", "", "two", "three"], [[["Name", ""], ["x  y", "1"]]], {1: (3, 0), 2: (3, 0), 3: (3, 1), 4: (3, 0)}, NUMBERING)
    page = docx.parse(content)
    assert page["text"] == "Title\n\n1. one\n\n2.a) two\n\n3. three\n\n|Name|Col2|\n|---|---|\n|x y|1|"
    assert (page["table_count"], page["paragraph_count"], page["block_count"]) == (1, 4, 5)


def test_docx_style_numbering():
    styles = '<w:style w:styleId="a"><w:basedOn w:val="b"/></w:style><w:style w:styleId="b"><w:basedOn w:val="a"/><w:pPr><w:numPr><w:numId w:val="3"/></w:numPr></w:pPr></w:style>'
    from xml.etree import ElementTree

    space = f'xmlns:w="{docx.W[1:-1]}"'
    held = docx.Numbering(ElementTree.fromstring(f"<w:n {space}>{NUMBERING}</w:n>"), ElementTree.fromstring(f"<w:s {space}>{styles}</w:s>"))
    mark = ElementTree.fromstring(f'<w:pPr {space}><w:pStyle w:val="a"/></w:pPr>')
    assert [held.prefix(mark), held.prefix(mark), held.prefix(None)] == ["1.", "2.", ""]


def test_load_from_disk(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"|a|b|\n\n\n x  y\xff")
    (tmp_path / "b.docx").write_bytes(docx.build(["hello"]))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.doc").write_bytes(b"x")
    got = {r.filename: r for r in files.load(files.uploads(spark, str(tmp_path)), strategy="clean").collect()}
    assert (got["a.txt"].text, got["a.txt"].method) == ("|a|b|\n\nx y", "text")
    assert (got["b.docx"].text, got["b.docx"].method) == ("hello", "python-docx")
    assert got["c.docx"].error and got["e.doc"].error and got["e.doc"].page is None
    assert (got["d.pdf"].text, got["d.pdf"].method) == ("", "text")
    pages = files.load(files.uploads(spark, str(tmp_path), "*.pdf"), extractors={"pypdf": lambda b: ["p1", "p2"]}).collect()
    assert sorted((r.page, r.text, r.method) for r in pages) == [(1, "p1", "pypdf"), (2, "p2", "pypdf")]


def test_catalog(spark, tmp_path):
    root = str(tmp_path / "catalog")
    chunks = spark.createDataFrame([(1, 1, 1, "1", 1, "你好")], "doc_id long, chunk_id int, page_number int, page_range string, word_count int, content string")
    totals = spark.createDataFrame([(1, 1, 1, 0)], "doc_id long, total_pages long, total_chunks long, total_images long")
    save = lambda run: catalog.save(catalog.documents(chunks, totals, spark.createDataFrame([(1, run, "a.txt", "text")], "doc_id long, run_id string, filename string, loading_method string")), root)
    save("r1")
    time.sleep(0.01)
    save("r2")
    (tmp_path / "catalog" / "json_name=old.json").mkdir()
    (tmp_path / "catalog" / "json_name=old.json" / "old.json").write_text(json.dumps({"chunks": [], "metadata": {"timestamp": "t"}}))
    (tmp_path / "catalog" / "json_name=bad.json").mkdir()
    (tmp_path / "catalog" / "json_name=bad.json" / "bad.json").write_text("[1]")
    held = {r.run_id: r for r in catalog.listed(catalog.scan(spark, root)).collect()}
    assert set(held) == {"r2", "old"} and held["r2"].total_chunks == 1 and held["old"].created_at == "t"
    row = catalog.get(catalog.scan(spark, root), "r2").first()
    assert row.load.chunks[0].content == "你好" and row.files[0].name == "a.json"
    assert catalog.delete(spark, root, "r2") and not catalog.delete(spark, root, "r2")


def test_assets(spark, tmp_path):
    df = spark.createDataFrame([(1, "r", "a.pdf", 2, 1, "PNG", bytearray(b"xx")), (1, "r", "a.pdf", 2, 2, None, None)], "doc_id long, run_id string, filename string, page int, image_number int, ext string, bytes binary")
    catalog.save_assets(df, str(tmp_path))
    assert (tmp_path / "assets" / "r" / "a_p2_img1.png").read_bytes() == b"xx"
    assert tuple(catalog.asset_summary(df).first()) == (1, 2, "assets/r")


def test_assistant(spark):
    df = spark.createDataFrame([("a", " hi "), (" ", "x"), ("b", " "), ("c", "boom"), ("d", "none")], "callId string, content string")

    def model(content):
        if content == "boom":
            raise OSError("down")
        return "" if content == "none" else [{"text": " x "}, "y", {"z": 1}]

    got = {r.callId: (r.answer, r.status) for r in assistant.ask(df, model).collect()}
    assert got == {"a": ("x\ny", 200), "": (None, 400), "b": (None, 400), "c": (None, 502), "d": (None, 500)}
    answers = spark.createDataFrame([(1, '```json\n{"names":[{"name":"张敏","confidence":"High","evidence":["1","2","3","4"]},{"name":" "}]}\n```'), (2, "no"), (3, '{"names":{}}')], "call_id long, answer string")
    assert [(r.call_id, r.name, r.confidence, r.evidence) for r in assistant.names(answers).collect()] == [(1, "张敏", "高", ["1", "2", "3"])]


HE = ["安徽省合肥市庐江县汤池镇百花小区9栋1109", "安徽省合肥市庐江县汤池镇百花小区9栋1110"]
FU = ["福州市岳峰镇保利香槟国际东区三号楼1201", "福州市岳峰镇保利香槟国际东区三号楼1200"]
ROOM = ["福建省福州市鼓楼区中山路保利香槟国际八号楼2103", "福建省福州市鼓楼区中山路保利香槟国际八号楼2101"]
TURNS = [
    ({"user_input": "汤池镇百花小区9栋1109", "address_list": HE}, {"matched_index": 0, "match_count": 1, "reply": "", "last_unmatched_address": "__NO_MERGE__:汤池镇百花小区9栋1109"}),
    ({"user_input": "安徽省庐江县百花小区9栋1109", "address_list": HE, "last_unmatched_address": "安徽省庐江县"}, {"matched_index": 0, "match_count": 1}),
    ({"user_input": "州市鼓楼区保利香槟国际8号楼2101", "address_list": ROOM}, {"matched_index": 1, "similar_no_match_count": 0}),
    ({"user_input": "州市鼓楼区保利香槟国际8号楼2101", "address_list": ROOM[:1]}, {"matched_index": -1, "reply": "请您提供正确完整的地址信息", "last_unmatched_address": "州市鼓楼区保利香槟国际8号楼2101"}),
    ({"user_input": "北京市大同区百花小区9栋1109", "address_list": HE}, {"reply": "请您提供正确完整的地址信息"}),
    ({"user_input": "庐江县", "address_list": HE, "last_unmatched_address": "合肥市", "similar_no_match_count": 1}, {"reply": "我记录的地址信息是：合肥市庐江县，请您再说一下具体的小区或村镇名称。", "last_unmatched_address": "合肥市庐江县", "similar_no_match_count": 0}),
    ({"user_input": "汤池镇", "address_list": HE, "matched_index": 0}, {"reply": "我记录的地址信息是：汤池镇，请您再说一下具体的小区或村镇名称。", "similar_no_match_count": 1}),
    ({"user_input": "保利香槟", "address_list": FU}, {"last_unmatched_address": "保利香槟", "similar_no_match_count": 0}),
    ({"user_input": "大塘村", "address_list": FU, "last_unmatched_address": "保利香槟"}, {"last_unmatched_address": "保利香槟", "similar_no_match_count": 1, "is_extract_failed": False}),
    ({"user_input": "三号楼", "address_list": FU, "last_unmatched_address": "保利香槟", "similar_no_match_count": 1}, {"last_unmatched_address": "保利香槟三号楼", "similar_no_match_count": 0}),
    ({"user_input": "广东省", "address_list": FU}, {"reply": "请您提供正确完整的地址信息", "last_unmatched_address": "__NO_MERGE__:广东省", "similar_no_match_count": 1}),
    ({"user_input": "福州市", "address_list": FU, "state": "completed", "matched_index": 0}, {"reply": "我记录的地址信息是：福州市，请您再说一下具体的小区或村镇名称。", "similar_no_match_count": 1}),
    ({"user_input": "不是", "address_list": HE, "state": "confirming", "matched_index": 0}, {"matched_index": -1, "match_count": 0, "reply": "请您提供详细的地址信息"}),
    ({"user_input": "是的", "address_list": HE, "state": "confirming", "matched_index": 1}, {"matched_index": 1, "is_completed": True, "reply": "", "last_unmatched_address": ""}),
]


@pytest.mark.parametrize("turn,expected", TURNS, ids=[t["user_input"] + str(i) for i, (t, _) in enumerate(TURNS)])
def test_address_turn(turn, expected):
    before = dict(turn)
    out = address.step(turn)
    assert {k: out[k] for k in expected} == expected and turn == before


def test_address_parts():
    assert address.canonical("江阳化工厂一百楼一单元三零二") == "江阳化工厂100#1单元302"
    assert address.merge("A120", "1201") == "A1201"
    assert address.merge(FU[0][:-1], "1201") == FU[0]


def test_dialogue_stream(spark, tmp_path):
    rows = [("c1", 1, "保利香槟", FU), ("c1", 2, "三号楼1201", FU), ("c2", 1, "汤池镇", HE)]
    schema = "call_id string, turn long, user_input string, address_list array<string>"
    spark.createDataFrame(rows[:1], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = dialogue.address_dialogue(stream, None).writeStream.format("memory").queryName("turns").outputMode("append").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame(rows[1:], schema).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.call_id, r.turn): (r.matched_index, r.state) for r in spark.sql("SELECT * FROM turns").collect()}
    assert got == {("c1", 1): (-1, "matching"), ("c1", 2): (0, "confirming"), ("c2", 1): (-1, "matching")}


def test_file_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    q = dialogue.arriving_files(spark, str(tmp_path)).select(F.col("content").cast("string").alias("t")).writeStream.format("memory").queryName("files").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r.t for r in spark.sql("SELECT * FROM files").collect()] == ["x"]


def test_rsa(spark):
    p, q = 2**521 - 1, 2**607 - 1
    n, d = p * q, pow(65537, -1, (p - 1) * (q - 1))
    size = (n.bit_length() + 7) // 8
    cipher = rsa.encrypt_bytes("你好, world".encode(), n, d, lambda k: b"\7" * k, 4)
    assert rsa.recover_bytes(cipher, n, 65537, size).decode() == "你好, world"
    out = spark.createDataFrame([("hello",), (None,)], "t string").select(rsa.encrypted(F.col("t"), n, 65537).alias("c")).collect()
    assert out[1].c is None and len(out[0].c) > 100


def test_costly_rows_are_dealt_out(spark, tmp_path):
    """Rows of one file are one split; costly ones are spread over tasks, also behind a shuffle that packs them small, with the same result."""
    import os

    from lectern.operators import rsa
    from lectern.plans import registry

    spark.range(1, 4502).selectExpr("id AS s_suppkey", "'Supplier ' || id AS s_name", "id AS c_custkey", "id AS p_partkey", "'a b' AS p_name", "'t' AS p_type", "'b' AS p_brand", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("customer", "part"):
        os.symlink(f"{tmp_path}/supplier.parquet", f"{tmp_path}/{name}.parquet")
    tasks = lambda name: registry.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions()
    assert tasks("rsa_round_trip") == 10 and tasks("docx_overrides") == tasks("docx_lists_and_tables") == 3
    assert tasks("address_dialogue") == int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = registry.queries()["address_dialogue"](spark, str(tmp_path))
    assert found.count() == 4 * 4501 and found.where("turn = 3 AND is_completed").count() == sum(k % 4 < 3 for k in range(1, 4502))
    p, q = 2**521 - 1, 2**607 - 1
    n, d = p * q, pow(65537, -1, (p - 1) * (q - 1))
    sealed = rsa.encrypt_bytes("é".encode() * 100, n, 65537, lambda k: b"\1" * k)
    assert rsa.recover_bytes(sealed, n, d, 141, (p, q)) == rsa.recover_bytes(sealed, n, d, 141) == "é".encode() * 100


def test_batches_for_workers_are_bounded_by_bytes(spark, data):
    from lectern.plans import registry

    spark._lectern_batches = False
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    registry.queries()["docx_pages"](spark, data)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
