"""Tables found by the places of words, for pages on which no ruled table was found.

Words (doc_id, page, x0, y0, x1, y1, text) become lines, islands over y; a line's words become cells, islands over x with a gap between
them; neighbouring lines of several cells make up a table; its columns are the islands over x of all its cells. All are windows of one
partitioning by page, and the result has the shape of the tables that :mod:`layout` takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.text import squeeze
from .sounds import dealt

#: Width of white space that sets cells of a line apart.
GAP = 8.0
PAGE = ("doc_id", "page")
FOUND = (*PAGE, "table_number", "x0", "y0", "x1", "y1", "cells")


def _before(column: str, window) -> Column:
    return F.max(column).over(window.rowsBetween(Window.unboundedPreceding, -1))


def _islands(rows: DataFrame, name: str, keys: tuple, order: list, start: Column) -> DataFrame:
    """``rows`` with ``name``: the island, from 0, that a row belongs to; ``start`` says where a new one begins."""
    line = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_new", F.coalesce(start, F.lit(False)).cast("int"))
    return rows.withColumn(name, F.sum("_new").over(line)).drop("_new")


def cells(words: DataFrame, gap: float = GAP) -> DataFrame:
    """(doc_id, page, line, cell, x0, y0, x1, y1, text): the cells of each line, words in their order.

    A word begins a line if its middle lies below all words before it, and a cell if more than ``gap`` is between it and the words before it.
    Blank words and words without a place are left out.
    """
    box = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    rows = words.select(*PAGE, *box, squeeze(F.col("text")).alias("text")).where("text <> '' AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    rows = dealt(rows, *PAGE)
    rows = rows.withColumn("middle", (F.col("y0") + F.col("y1")) / 2)
    down = ["middle", "x0", "x1", "text"]
    rows = _islands(rows, "line", PAGE, down, F.col("middle") > _before("y1", Window.partitionBy(*PAGE).orderBy(*down)))
    across = ["x0", "x1", "text"]
    rows = _islands(rows, "cell", (*PAGE, "line"), across, F.col("x0") > _before("x1", Window.partitionBy(*PAGE, "line").orderBy(*across)) + gap)
    ends = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    held = F.sort_array(F.collect_list(F.struct("x0", "x1", "text")))
    return rows.groupBy(*PAGE, "line", "cell").agg(*ends, F.array_join(F.transform(held, lambda w: w["text"]), " ").alias("text"))


def found(words: DataFrame, gap: float = GAP, least_lines: int = 2) -> DataFrame:
    """(FOUND) of ``words``: ``least_lines`` neighbouring lines of two cells at least; what does not look like a table is left out."""
    rows = cells(words, gap)
    line = Window.partitionBy(*PAGE, "line")
    rows = rows.withColumn("n", F.count("*").over(line)).where("n > 1")
    # Lines that follow each other keep their distance to their rank among the lines that are left.
    rows = rows.withColumn("area", F.col("line") - F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("line")))
    area = (*PAGE, "area")
    across = ["x0", "x1", "line"]
    rows = _islands(rows, "column", area, across, F.col("x0") > _before("x1", Window.partitionBy(*area).orderBy(*across)))
    one = rows.groupBy(*area, "line", "column").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda c: c["text"]), " ").alias("text"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])
    ends = lambda: [*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")]]
    lines = one.groupBy(*area, "line").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("by_column"), F.max("column").alias("last"), *ends())
    whole = lines.groupBy(*area).agg(F.sort_array(F.collect_list(F.struct("line", F.map_entries("by_column").alias("held")))).alias("held"), F.max("last").alias("last"), F.count("*").alias("lines"), *ends())
    row = lambda r: F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda k: F.coalesce(F.try_element_at(F.map_from_entries(r["held"]), k), F.lit("")))
    whole = whole.where(F.col("lines") >= least_lines).withColumn("cells", F.transform("held", row)).where(tables.admitted(F.col("cells")))
    return whole.withColumn("table_number", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0"))).select(*FOUND)


def detected(ruled: DataFrame, words: DataFrame, gap: float = GAP) -> DataFrame:
    """Two passes: the tables ``ruled`` (FOUND) that a first finder gives and that are admitted, and on pages that have none of these those of their words."""
    first = ruled.where(tables.admitted(F.col("cells"))).select(*FOUND)
    rest = words.join(first.select(*PAGE).distinct(), list(PAGE), "left_anti")
    return first.unionByName(found(rest, gap))
