"""Chunkers as table functions against the column expressions."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lectern.functions import table_functions
from lectern.operators import chunking

TEXTS = ["", None, " \n ", "one two three", "a. b! c。d；e 1.5 is. ok", "x" * 250 + ". " + "y. " * 90, "p q\n\n r\x1cs　t.\n \n\nu? v", " w " * 37, "你好。世界！" * 60]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(d, p, TEXTS[(d * 3 + p) % len(TEXTS)]) for d in range(7) for p in range(1, 2 + d % 4)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, text string").withColumn("extra", F.lit(1)).repartition(3)
    df.createOrReplaceTempView("pages_")
    table_functions.register(spark)
    return df


@pytest.mark.parametrize("call, strategy, options", [
    ("chunk_fixed_size(TABLE(pages_))", "fixed_size", {}), ("chunk_fixed_size(TABLE(pages_), chunk_size => 4, overlap => 9)", "fixed_size", {"chunk_size": 4, "overlap": 9}), ("chunk_fixed_size(TABLE(pages_), 5, NULL)", "fixed_size", {"chunk_size": 5, "overlap": 50}),
    ("chunk_sentence(TABLE(pages_))", "sentence", {}), ("chunk_sentence(TABLE(pages_), max_chars => 110)", "sentence", {"max_chars": 110}), ("chunk_by_page(TABLE(pages_))", "by_page", {}),
])
def test_as_the_expressions(spark, pages, call, strategy, options):
    got = spark.sql(f"SELECT * FROM {call}")
    want = chunking.chunk(pages.drop("extra"), strategy, options)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_arguments(spark, pages):
    for call in ("chunk_sentence(TABLE(SELECT doc_id FROM pages_))", "chunk_sentence(3)", "chunk_fixed_size(TABLE(pages_), 'x')"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {call}").collect()
    assert spark.sql("SELECT * FROM chunk_by_page(TABLE(SELECT * FROM pages_ WHERE false))").count() == 0
