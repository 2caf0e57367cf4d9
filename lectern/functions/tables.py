"""Column expressions on tables given as ARRAY<ARRAY<STRING>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze


def normalized(cells: Column) -> Column:
    """Squeezed cells, null ones empty; rows without a filled cell go."""
    rows = F.transform(cells, lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: squeeze(F.coalesce(c, F.lit("")))))
    return F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))


def filled(row: Column) -> Column:
    return F.size(F.filter(row, lambda c: squeeze(F.coalesce(c, F.lit(""))) != ""))


def looks_like_table(cells: Column) -> Column:
    """At least two rows with two filled cells each, and four filled cells in all."""
    counts = F.transform(cells, filled)
    return F.coalesce((F.size(F.filter(counts, lambda n: n >= 2)) >= 2) & (F.aggregate(counts, F.lit(0), lambda a, n: a + n) >= 4), F.lit(False))


def markdown(cells: Column) -> Column:
    """A markdown table; its first row is the header, blank header cells are Col1, Col2 ...; empty if no cell is filled."""
    rows = normalized(cells)
    width = F.array_max(F.transform(rows, F.size))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    header = F.transform(F.get(padded, F.lit(0)), lambda c, i: F.when(c == "", F.concat(F.lit("Col"), (i + 1).cast("string"))).otherwise(c))
    line = lambda r: F.concat(F.lit("|"), F.array_join(r, "|"), F.lit("|"))
    body = F.transform(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))), line)
    text = F.array_join(F.concat(F.array(line(header), line(F.array_repeat(F.lit("---"), width))), body), "\n")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, "").otherwise(text)


def admitted(cells: Column) -> Column:
    """Whether a detected table counts: two rows and two columns at least, it looks like one, and it renders."""
    width = F.array_max(F.transform(cells, F.size))
    return F.coalesce((F.size(cells) >= 2) & (width >= 2) & looks_like_table(cells) & (markdown(cells) != ""), F.lit(False))


def coalesced(first: Column, second: Column) -> Column:
    """Two-pass detection: the second finder's tables count only if the first has found none."""
    return F.when(F.coalesce(F.size(first), F.lit(0)) > 0, first).otherwise(second)
