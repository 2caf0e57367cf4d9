"""Registered queries against their SQL, and parameters of their operators."""

import pytest
from pyspark.sql import functions as F

from lectern.llm import registry, url_filter


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    columns = ", ".join(sorted(df.columns))
    found = duck.sql(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr) == sorted(found, key=repr)


@pytest.mark.parametrize("name", ["op4_embeddings", "op5_packing", "op7_warc", "op9_toxicity", "op10_sentencepiece"])
def test_tables_without_rows_and_with_clashing_columns(spark, data, tmp_path, name):
    """Empty tables whose further columns have the names that operators give their own."""
    for table in ("documents", "embeddings", "pages", "labels"):
        rows = spark.read.parquet(f"{data}/{table}.parquet").where("false")
        own = [c for c in ("rep", "n", "payload", "chunk", "data", "last", "score", "sequence_id", "list", "bad", "host") if c not in rows.columns]
        rows.select("*", *[F.lit(1).alias(c) for c in own]).write.parquet(f"{tmp_path}/{table}.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == 0


def test_url_settings(spark):
    """A branch of 30 good urls and one of 12, 9 of them bad: smoothed purity 0.49 if apart, 0.79 if they fall together."""
    urls = [("h", f"/a/b{i}", 0) for i in range(30)] + [("h", f"/spam/c{i}", int(i < 9)) for i in range(12)]
    df = spark.createDataFrame(urls, "host string, path string, bad int")
    assert url_filter.fit(df).count() == 12
    assert url_filter.fit(df, least=31).count() == 0
    assert url_filter.fit(df, least_purity=0.45).count() == 0
    assert url_filter.fit(df, least_purity=0.45, weight=1.0).count() == 12
