"""Automatic list numbers of paragraphs.

Paragraphs are rows (doc_id, para_no, num_id, ilvl, text) with the level's start, num_fmt and lvl_text; levels of a
list are rows (num_id, ilvl, start, num_fmt, lvl_text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import list_number, strip


def effective(own: Column, style: Column) -> Column:
    """A paragraph's own value before its style's."""
    return F.coalesce(own, style)


def level(ilvl: Column) -> Column:
    return F.greatest(F.coalesce(ilvl, F.lit(0)), F.lit(0))


def resolved_styles(styles: DataFrame) -> DataFrame:
    """(style_id, num_id, ilvl) with values inherited along based_on to the chain's end; a cycle is gone round once.

    Each round takes over the values of the style that a style points to and doubles the reach of its pointer, so
    the rounds are the logarithm of the number of styles.
    """
    step = styles.select("style_id", "based_on", "num_id", "ilvl")
    for _ in range(styles.count().bit_length()):
        ahead = step.select(F.col("style_id").alias("a_id"), F.col("based_on").alias("a_on"), F.col("num_id").alias("a_num"), F.col("ilvl").alias("a_lvl"))
        step = step.join(ahead, F.col("based_on") == F.col("a_id"), "left").select("style_id", F.col("a_on").alias("based_on"), F.coalesce("num_id", "a_num").alias("num_id"), F.coalesce("ilvl", "a_lvl").alias("ilvl"))
    return step.select("style_id", "num_id", "ilvl")


#: Levels of a list.
LEVELS = 9


def counted(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` with ``counters``: the value of each level of their list at that paragraph, a map; null for those without a number.

    A level counts on from its start and begins again after a paragraph of its list with a lower level. Rows
    without num_id or without a level definition (null start) take no number. Blank paragraphs take one. Start is one
    for each level of a list. All counts run along one window.
    """
    names = paragraphs.columns
    numbered = F.col("num_id").isNotNull() & F.col("start").isNotNull()
    rows = paragraphs.select(F.struct(*names).alias("row"), "doc_id", "num_id", "para_no", "start", F.when(numbered, level(F.col("ilvl"))).alias("ilvl"))
    so_far = Window.partitionBy("doc_id", "num_id").orderBy("para_no").rowsBetween(Window.unboundedPreceding, 0)
    levels = range(LEVELS)
    rows = rows.withColumns({f"n{k}": F.count(F.when(F.col("ilvl") == k, 1)).over(so_far) for k in levels} | {f"s{k}": F.last(F.when(F.col("ilvl") == k, F.col("start")), True).over(so_far) for k in levels})
    rows = rows.withColumns({f"b{k}": F.coalesce(F.last(F.when(F.col("ilvl") < k, F.col(f"n{k}")), True).over(so_far), F.lit(0)) for k in levels})
    value = lambda k: F.when(F.col(f"n{k}") > F.col(f"b{k}"), (F.col(f"s{k}") - 1 + F.col(f"n{k}") - F.col(f"b{k}")).cast("int"))
    held = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, levels)), F.array(*map(value, levels))), lambda _, v: v.isNotNull())
    own = {"ilvl": F.when(F.col("ilvl").isNull(), F.col("row.ilvl")).otherwise(F.col("ilvl"))}
    return rows.select(*(own.get(x, F.col(f"row.`{x}`")).alias(x) for x in names), F.when(F.col("ilvl").isNotNull(), held).alias("counters"))


def counters(paragraphs: DataFrame) -> DataFrame:
    """The rows of :func:`counted` that have a number."""
    return counted(paragraphs).where("counters is not null")


def values(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` with ``value``, the counter of their own level, by windows alone (start is one for each level of a list).

    The value is start - 1 + the rows of the level since the last row of the list with a lower level.
    """
    rows = paragraphs.where("num_id is not null and start is not null").withColumn("ilvl", level(F.col("ilvl")))
    of_list = Window.partitionBy("doc_id", "num_id").orderBy("para_no")
    top = LEVELS
    for k in range(1, top):
        rows = rows.withColumn(f"_r{k}", F.count(F.when(F.col("ilvl") < k, 1)).over(of_list))
    reset = F.lit(0).cast("long")
    for k in range(1, top):
        reset = F.when(F.col("ilvl") == k, F.col(f"_r{k}")).otherwise(reset)
    rows = rows.withColumn("_reset", reset).drop(*[f"_r{k}" for k in range(1, top)])
    run = Window.partitionBy("doc_id", "num_id", "ilvl", "_reset").orderBy("para_no")
    return rows.withColumn("value", (F.col("start") - 1 + F.row_number().over(run)).cast("int")).drop("_reset")


def rendered(lvl_text: Column, ilvl: Column, held: Column, starts: Column, formats: Column) -> Column:
    """The template with %1 ... %9 replaced by the levels' counters, or their starts; without any it is literal."""
    text = F.coalesce(F.nullif(lvl_text, F.lit("")), F.concat(F.lit("%"), (ilvl + 1).cast("string")))
    digit = lambda x: F.nullif(F.instr(F.lit("123456789"), F.nullif(F.substring(x, 1, 1), F.lit(""))), F.lit(0))
    used = F.filter(F.transform(F.split(text, "%"), digit), lambda k: k.isNotNull())

    def shown(k):
        number = F.coalesce(F.try_element_at(held, k - 1), F.try_element_at(starts, k - 1), F.lit(1))
        return list_number(number, F.coalesce(F.try_element_at(formats, k - 1), F.lit("decimal")))

    put = lambda out, k: F.replace(out, F.concat(F.lit("%"), k.cast("string")), shown(k))
    return strip(F.aggregate(F.sort_array(F.array_distinct(used), False), text, put))


def prefixed(paragraphs: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc_id, para_no, prefix, text): every paragraph with its list number before a text that is not blank."""
    of = levels.groupBy("num_id").agg(F.map_from_entries(F.collect_list(F.struct("ilvl", "start"))).alias("starts"), F.map_from_entries(F.collect_list(F.struct("ilvl", "num_fmt"))).alias("formats"))
    rows = counted(paragraphs).join(of, "num_id", "left")
    prefix = F.when(F.col("counters").isNotNull(), rendered(F.col("lvl_text"), F.col("ilvl"), F.col("counters"), F.col("starts"), F.col("formats")))
    prefix = F.coalesce(prefix, F.lit(""))
    out = rows.select("doc_id", "para_no", prefix.alias("prefix"), strip(F.coalesce("text", F.lit(""))).alias("text"))
    whole = F.when(F.col("text") == "", "").when(F.col("prefix") == "", F.col("text")).otherwise(F.concat("prefix", F.lit(" "), "text"))
    return out.select("doc_id", "para_no", "prefix", whole.alias("text"))
