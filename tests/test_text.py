"""Text, options, tables and chunking on literal inputs."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import options, tables, text
from lectern.operators import chunking


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_squeeze_and_words(spark):
    assert one(spark, text.squeeze(F.col("a")), a="  a  b\x1c\nc ") == "a b c"
    assert one(spark, text.word_count(F.col("a")), a=" a  b\tc ") == 3
    assert one(spark, text.word_count(F.col("a")), a="") == 0
    assert one(spark, text.utf16_length(F.col("a")), a="😀a") == 3


def test_clean_keeps_tables(spark):
    assert one(spark, text.clean_extracted(F.col("a")), a="x\n\n\n|a  |\tb|\n y  z\n") == "x\n\n|a | b|\ny z"
    assert one(spark, text.clean_extracted(F.col("a")), a="x\n\n\n a|b \n") == "x a|b"


def test_safe_filename(spark):
    for name, expected in (("a/b/c?.txt", "c_.txt"), ("  .. ", "up"), ("", "up"), (None, "up"), ("a:b*.pdf. ", "a_b_.pdf"), ("/", "up"), ("..", "up")):
        assert one(spark, text.safe_filename(F.col("a"), "up"), a=name) == expected, name


def test_numbers(spark):
    for n, a, r in ((1, "A", "I"), (4, "D", "IV"), (26, "Z", "XXVI"), (27, "AA", "XXVII"), (0, "A", "I"), (703, "AAA", "DCCIII"), (3999, "EWU", "MMMCMXCIX")):
        assert one(spark, text.letters(F.col("n")), n=n) == a
        assert one(spark, text.roman(F.col("n")), n=n) == r
    assert one(spark, text.list_number(F.col("n"), F.lit("decimalZero")), n=3) == "3"
    assert one(spark, text.list_number(F.col("n"), F.lit("lowerRoman")), n=9) == "ix"


def test_options(spark):
    kind = lambda a, b: one(spark, options.document_type(F.col("a"), F.col("b")), a=a, b=b)
    assert (kind("a.PDF", None), kind("a", "application/pdf; x=1"), kind("a.doc", "application/pdf"), kind("a.txt", None)) == ("pdf", "pdf", "doc", None)
    assert one(spark, options.flags(F.col("a")), a="Clean, no-images|x+clean") == ["clean", "no_images", "x"]
    assert options.check_chunking("fixed_size", chunk_size=10, overlap=10) and not options.check_chunking("fixed_size", chunk_size=10, overlap=9)
    assert options.check_chunking("sentence", max_chars=99)
    for raw, good in (('{"a": 1}', True), ("[1]", False), ("", False), (None, False), ("[object Object]", False), ("{x", False)):
        assert one(spark, options.chunking_options(F.col("a")).isNotNull(), a=raw) is good


def test_sizes(spark):
    assert [one(spark, text.file_size(F.col("n")), n=n) for n in (5, 1536, 3 << 20)] == ["5 B", "1.5 KB", "3.00 MB"]


def test_tables(spark):
    cells = F.array(F.array(F.lit("a"), F.lit(" ")), F.array(F.lit("b"), F.lit("c"), F.lit("d")))
    assert one(spark, tables.markdown(cells)) == "|a|Col2|Col3|\n|---|---|---|\n|b|c|d|"
    assert one(spark, tables.looks_like_table(cells)) is False
    assert one(spark, tables.markdown(F.array(F.array(F.lit(" "))))) == ""


def test_sentences(spark):
    split = lambda x: one(spark, chunking.sentences(F.col("a")), a=x)
    assert split("a. b! c。d；e") == ["a.", "b!", "c。", "d；", "e"]
    assert split("1.5 is. ok") == ["1.5 is.", "ok"]
    assert split("") == []
    assert one(spark, chunking.packed_sentences(F.col("a"), 5), a="x" * 150 + ". y.") == ["x" * 150 + ".", "y."]


def windows(words, size, overlap):
    size = max(1, size)
    step = size - min(max(0, overlap), size - 1)
    out = []
    for i in range(0, len(words), step):
        out.append(" ".join(words[i : i + size]))
        if i + size >= len(words):
            break
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=3), max_size=30), st.integers(0, 8), st.integers(-1, 9))
def test_fixed_windows(spark, words, size, overlap):
    assert one(spark, chunking.fixed_windows(F.col("a"), size, overlap), a=" ".join(words)) == windows(words, size, overlap)


def packed(value, most):
    out, now = [], ""
    for block in re.split(r"\n\s*\n+", value):
        for s in re.split(r"(?<=[。！？；])|(?<=[.!?])\s+", block):
            if s := s.strip():
                if now and len(now) + 1 + len(s) > max(100, most):
                    out.append(now)
                    now = s
                else:
                    now = f"{now} {s}" if now else s
    return out + [now] * bool(now)


@settings(max_examples=15, deadline=None)
@given(st.text("ab。. !\n；", max_size=400))
def test_packed_sentences(spark, value):
    assert one(spark, chunking.packed_sentences(F.col("a"), 100), a=value) == packed(value, 100)


def test_empty_pages(spark):
    pages = spark.createDataFrame([(1, 1, ""), (1, 2, "a b"), (2, 1, None)], "doc_id long, page_number int, text string")
    assert sorted(map(tuple, chunking.chunk(pages, "by_page").select("doc_id", "chunk_id", "content").collect())) == [(1, 1, ""), (1, 2, "a b"), (2, 1, "")]
    assert [tuple(r) for r in chunking.chunk(pages, "sentence").select("doc_id", "chunk_id", "page_number").collect()] == [(1, 1, 2)]
    held = {r.doc_id: (r.total_pages, r.total_chunks) for r in chunking.totals(pages, chunking.chunk(pages, "fixed_size")).collect()}
    assert held == {1: (2, 1), 2: (1, 0)}


def test_strip_takes_what_python_takes(spark):
    """Every character that Python counts as white space, and none besides, at both ends."""
    assert set(text.BLANKS) == {c for c in map(chr, range(0x110000)) if c.isspace()}
    cases = [c + "x" + c for c in map(chr, range(1, 0x3100))] + [text.BLANKS, "", None, text.BLANKS + "a b" + text.BLANKS]
    got = spark.createDataFrame([(x,) for x in cases], "t string").select(text.strip(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [x if x is None else x.strip() for x in cases]


def test_counts_are_those_of_the_chunks(spark):
    texts = ["", None, " ", "one two three", "a. b! c。d；e", "x" * 250 + ". " + "y. " * 90, "w " * 37, "你好。世界！" * 60]
    rows = [(d, p, texts[(d * 3 + p) % len(texts)], p) for d in range(9) for p in range(1, 2 + d % 4)]
    pages = spark.createDataFrame(rows, "doc_id long, page_number int, text string, image_count int")
    for strategy, options in (("by_page", None), ("sentence", {"max_chars": 110}), ("fixed_size", {"chunk_size": 3, "overlap": 1}), ("fixed_size", {"chunk_size": 4, "overlap": 9}), (None, None)):
        want = chunking.totals(pages, chunking.chunk(pages, strategy, options))
        assert sorted(map(tuple, chunking.counts(pages, strategy, options).collect())) == sorted(map(tuple, want.select("doc_id", "total_pages", "total_chunks", "total_images").collect()))
