"""Corpus pipeline over ``documents``: toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.

Defined results of every stage: no rows give no rows; a null in lang, source or n_chars stays as it is and changes nothing else;
further columns are passed on, whatever their names, by all but the last; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common, jaccard_join, packing, substring_dedup, toxicity

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity classifier rejects; it learns from the labels of rows that are not held out.

    Null and empty texts have the score of no features and are judged by it like any other; rows that repeat are judged alike, and a
    score that ties with the threshold is rejected. Without labels every score is 0.5, so nothing is left; with one class alone all go or stay.
    """
    labels = common.table(spark, sf_dir, "labels").where(~toxicity.held_out())
    model = toxicity.train(docs, labels)
    return toxicity.filtered(docs, model, toxicity.THRESHOLD)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates; rows without an id stay.

    Null, empty and blank texts are in no group and stay; rows that repeat an id go or stay together.
    """
    common.ship(spark)
    found = jaccard_join.near_duplicates(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; documents of which nothing is left go.

    Null, empty and short texts and rows without an id stay as they are; of rows that repeat an id with different texts one takes part
    and the others stay as they are, equal ones are cut alike. n_chars follows the text unless it is null.
    """
    common.ship(spark)
    out = substring_dedup.cut(docs, substring_dedup.repeats(docs))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into sequences.

    A null text counts as empty and is the end id alone; rows that repeat are packed each for itself.
    """
    common.ship(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each_group), ("repeated_passages", cut_repeats), ("packing", pack)]

#: No stage can be expressed in SQL whole; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.save(docs, name)
    return docs
