"""Registered queries over tables without rows, with columns of the operators' own names, and with repeated rows."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import registry

TABLES = ("documents", "pages", "labels", "embeddings", "benchmark")
CLASH = ("key", "n", "score", "rank", "shard", "term", "sig", "lo", "hi", "a", "b", "host", "path", "words", "size", "component_id", "chosen", "found", "doc", "query_id", "part", "bad", "template")


def written(spark, data, folder, rows):
    """The tables below ``folder``, each as ``rows`` makes it of its frame, with further columns whose names clash."""
    for t in TABLES:
        df = rows(spark.read.parquet(f"{data}/{t}.parquet"))
        df.select("*", *[F.lit(1).alias(c) for c in CLASH if c not in df.columns]).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["op1_html", "op2_url_filter", "op3_substring_dedup", "op6_jaccard", "op8_bm25", "pipeline"])
def test_tables_without_rows(spark, data, tmp_path, name):
    folder = written(spark, data, tmp_path, lambda df: df.where("false"))
    run = corpus_pipeline.run if name == "pipeline" else registry.queries()[name]
    assert run(spark, folder).count() == 0


def plain(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", ["op2_url_filter", "op6_jaccard", "op8_bm25", "op13_token_counts"])
def test_columns_that_clash_change_nothing(spark, data, tmp_path, name):
    few = {"documents": "doc_id < 60", "labels": "doc_id < 60", "pages": "page_id < 60"}

    def rows(df):
        at = next((v for k, v in few.items() if set(spark.read.parquet(f"{data}/{k}.parquet").columns) == set(df.columns)), "true")
        return df.where(at)

    folder = written(spark, data, tmp_path / "clash", rows)
    os.makedirs(tmp_path / "plain")
    for t in TABLES:
        rows(spark.read.parquet(f"{data}/{t}.parquet")).write.parquet(f"{tmp_path}/plain/{t}.parquet")
    query = registry.queries()[name]
    assert plain(query(spark, folder)) == plain(query(spark, f"{tmp_path}/plain"))


def test_repeated_rows(spark, data, tmp_path):
    """Rows that are there twice: op10 and op13 give each twice; op5 packs each for itself, without a gap; op4 counts the other one as a link."""
    for t in TABLES:
        df = spark.read.parquet(f"{data}/{t}.parquet").limit(40)
        df.union(df).write.parquet(f"{tmp_path}/{t}.parquet")
        df.write.parquet(f"{tmp_path}/once/{t}.parquet")
    for name in ("op10_sentencepiece", "op13_token_counts"):
        assert plain(registry.queries()[name](spark, str(tmp_path))) == sorted(plain(registry.queries()[name](spark, f"{tmp_path}/once")) * 2, key=repr)
    once = {r.doc_id: r.doc_tokens for r in registry.queries()["op5_packing"](spark, f"{tmp_path}/once").collect()}
    pieces = registry.queries()["op5_packing"](spark, str(tmp_path)).collect()
    held = {}
    for r in pieces:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
    assert held == {k: 2 * v for k, v in once.items()}
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    links = {r.vec_id: r.n_links for r in registry.queries()["op4_embeddings"](spark, f"{tmp_path}/once").collect()}
    twice = registry.queries()["op4_embeddings"](spark, str(tmp_path)).collect()
    assert len(twice) == 2 * len(links) and all(r.n_links == 2 * links[r.vec_id] + 1 for r in twice)
