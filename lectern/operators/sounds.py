"""Spoken text against candidate texts by sound: homophones are corrected and what is no address is cut off.

A table of readings gives the syllables of characters, several rows for a character with several readings; it is the
caller's, or ICU's (:func:`icu_readings`). Syllables that are easily confused make up classes. Each character of a spoken
text is joined with the characters of its candidates that have a class in common, and neighbouring pairs of one
diagonal make up a run: a stretch of the spoken text that sounds like a stretch of a candidate. A run counts if it is long
enough for what it changes and holds a character that is the same in both. A character is corrected if the longest
runs over it agree on one form, and so do they over all the rest of their run; where two forms sound alike, the text stays.

All of it is joins and windows keyed by the caller's ``key``, which has to tell the rows apart; rows with a null key or text stay as
they are. Numerals stay as spoken: 三 and 3 are the same character here. The table of readings, which a language bounds, is broadcast; what
has rows of the calls never is: it is packed so small in a shuffle that its size there says nothing about its size on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a run: if it changes nothing, if it changes homophones, if it changes merely confusable ones.
LEAST = (2, 2, 3)
# What is easily confused. Retroflex and dental initials, front and back nasals, hu- before a vowel and f-.
CONFUSED = (("^zh", "z"), ("^ch", "c"), ("^sh", "s"), ("ng$", "n"), ("^hu(?=[aeo])", "f"))
NUMERALS, FIGURES = "零〇一二三四五六七八九两幺", "0012345678921"
# What marks a stretch as part of an address, and how people begin who are about to say one.
PLACE_MARKS = "[0-9A-Za-z省市县区镇乡村路街巷道门号栋幢楼座室]|单元|小区|花园|大厦|[零〇一二三四五六七八九十百千两幺]$"
INTRODUCTION = "^(?:喂|嗯|呃|啊|你好|您好|那个|这个|就是|我家?(?:住在|是在|在|住)|麻烦你?|请你?|帮我|给我|查一下|查查|看一下|报修|地址是)+"


def folded(x: Column) -> Column:
    """Numerals as figures, so that both ways to write a digit are one character."""
    return F.translate(x, NUMERALS, FIGURES)


def confusable(readings: DataFrame, rules=CONFUSED) -> DataFrame:
    """(a, b): each syllable of ``readings`` with what it is confused with by ``rules``, replacements in turn."""
    heard = F.col("syllable")
    for pattern, instead in rules:
        heard = F.regexp_replace(heard, pattern, instead)
    return readings.select(F.col("syllable").alias("a"), heard.alias("b")).distinct()


def classes(pairs: DataFrame) -> DataFrame:
    """(syllable, class) of a graph of confusable syllables (a, b): class is the least syllable that edges lead to.

    In each round a syllable takes the least class of its neighbours; the rounds end when none changes, after as many as the longest chain has edges.
    The table holds a language's syllables, some hundreds.
    """
    edges = pairs.where("a <> b").select("a", "b")
    edges = edges.union(edges.select("b", "a")).distinct()
    now = pairs.select(F.explode(F.array("a", "b")).alias("syllable")).where("syllable IS NOT NULL").distinct().withColumn("class", F.col("syllable"))
    while True:
        heard = edges.join(now, edges.b == now.syllable).groupBy("a").agg(F.min("class").alias("least"))
        then = now.join(heard, F.col("syllable") == F.col("a"), "left").select("syllable", F.least("class", F.coalesce("least", "class")).alias("class"), (F.col("least") < F.col("class")).alias("moved"))
        rows = then.collect()  # some hundreds of syllables
        now = pairs.sparkSession.createDataFrame([(r["syllable"], r["class"]) for r in rows], "syllable string, class string")
        if not any(r["moved"] for r in rows):
            return now


def icu_readings(spark: SparkSession) -> DataFrame:
    """(char, syllable) of the basic Chinese characters by ICU, which Spark brings along: one reading each, some 20,900 rows.

    Characters with several readings need further rows of the caller's.
    """
    if not hasattr(spark, "sparkContext"):
        raise ValueError("ICU is reached through the driver's JVM, which this session does not have")
    change = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Latin-ASCII")
    chars = [chr(x) for x in range(0x4E00, 0x9FA6)]
    heard = change.transliterate("\n".join(chars)).split("\n")
    return spark.createDataFrame([(c, h.strip()) for c, h in zip(chars, heard) if h.strip().isascii()], "char string, syllable string")


def sounding(readings: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(char, syllables, classes) of ``readings``; ``pairs`` are the confusable syllables, by the rules if None."""
    known = classes(confusable(readings) if pairs is None else pairs)
    found = readings.join(known, "syllable", "left").withColumn("class", F.coalesce("class", "syllable"))
    return found.groupBy("char").agg(F.collect_set("syllable").alias("syllables"), F.collect_set("class").alias("classes"))


def _letters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in as many partitions as the session has for shuffles: their packed sizes would merge them into a few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _spelled(rows: DataFrame, sounds: DataFrame, at: str, char: str) -> DataFrame:
    """``rows`` with a row for each thing that a character can be met by: itself, and its classes."""
    heard = rows.join(F.broadcast(sounds.select(F.col("char").alias(char), "syllables", "classes")), char, "left")
    met = F.array_union(F.array(F.concat(F.lit("="), folded(F.col(char)))), F.coalesce("classes", F.array().cast("array<string>")))
    return heard.select("*", F.explode(met).alias("met")).drop("classes").withColumnRenamed("syllables", f"{at}_syllables")


def runs(calls: DataFrame, sounds: DataFrame, key: str = "call_id", spoken: str = "spoken", candidates: str = "address_list") -> DataFrame:
    """Pairs of characters in runs: (key, cand, i, j, said, meant, kind, length, worst, same, island, diagonal).

    kind is 0 for the same character, 1 for homophones, 2 for confusable ones; length, worst (the highest kind) and
    same (pairs of kind 0) are those of the pair's run. All runs are there, also those that do not count (:func:`counts`).
    """
    there = calls.where(F.col(key).isNotNull())
    said = there.select(F.col(key).alias("key"), F.posexplode(_letters(F.col(spoken))).alias("i", "said"))
    known = there.select(F.col(key).alias("key"), F.posexplode(candidates).alias("cand", "text")).select("key", "cand", F.posexplode(_letters(F.col("text"))).alias("j", "meant"))
    met = dealt(_spelled(said, sounds, "said", "said"), "key", "met").join(dealt(_spelled(known, sounds, "meant", "meant"), "key", "met").hint("merge"), ["key", "met"])
    kind = F.when(folded(F.col("said")) == folded(F.col("meant")), 0).when(F.coalesce(F.arrays_overlap("said_syllables", "meant_syllables"), F.lit(False)), 1).otherwise(2)
    # From here on one partition holds all of a key, which every window below goes by.
    pairs = met.select("key", "cand", "i", "j", "said", "meant", kind.alias("kind"), (F.col("i") - F.col("j")).alias("diagonal"))
    pairs = dealt(pairs, "key").dropDuplicates(["key", "cand", "i", "j"])
    line = Window.partitionBy("key", "cand", "diagonal").orderBy("i")
    pairs = pairs.withColumn("island", F.col("i") - F.row_number().over(line))
    run = Window.partitionBy("key", "cand", "diagonal", "island")
    return pairs.withColumns({"length": F.count("*").over(run), "worst": F.max("kind").over(run), "same": F.count(F.when(F.col("kind") == 0, 1)).over(run)})


def counts(least=LEAST) -> Column:
    """Whether a run is evidence: as long as what it changes asks for, and anchored by a character that is the same."""
    return (F.col("same") > 0) & (F.col("length") >= F.element_at(F.array(*map(F.lit, least)), F.col("worst") + 1))


def corrected(calls: DataFrame, sounds: DataFrame, key: str = "call_id", spoken: str = "spoken", candidates: str = "address_list", least=LEAST) -> DataFrame:
    """``calls`` with ``corrected``, ``changes`` array<struct<at, said, meant>> and ``ambiguous``: some stretch sounds like two forms."""
    pairs = runs(calls, sounds, key, spoken, candidates).where(counts(least)).withColumn("form", F.when(F.col("kind") == 0, F.col("said")).otherwise(F.col("meant")))
    over, level, run = Window.partitionBy("key", "i"), Window.partitionBy("key", "i", "length"), Window.partitionBy("key", "cand", "diagonal", "island")
    pairs = pairs.withColumns({"longest": F.col("length") == F.max("length").over(over), "agreed": F.min("form").over(level) == F.max("form").over(level)})
    pairs = pairs.withColumn("settled", F.min(F.col("longest") & F.col("agreed")).over(run))
    change = F.when(F.col("settled") & (F.col("kind") > 0), F.struct("i", "said", F.col("form").alias("meant")))
    found = pairs.groupBy("key").agg(F.sort_array(F.collect_set(change)).alias("_found"), F.max(F.col("longest") & ~F.col("agreed")).alias("_two"))
    out = calls.join(found.hint("merge"), F.col(key) == F.col("key"), "left")
    by_place = F.map_from_entries(F.transform("_found", lambda x: F.struct(x["i"], x["meant"])))
    mended = F.array_join(F.transform(_letters(F.col(spoken)), lambda c, i: F.coalesce(F.try_element_at(by_place, i), c)), "")
    return out.select(
        *[calls[c] for c in calls.columns], F.when(F.size("_found") > 0, mended).otherwise(F.col(spoken)).alias("corrected"),
        F.transform(F.coalesce("_found", F.array().cast("array<struct<i: int, said: string, meant: string>>")), lambda x: F.struct(x["i"].alias("at"), x["said"], x["meant"])).alias("changes"),
        F.coalesce("_two", F.lit(False)).alias("ambiguous"),
    )


def cleaned(calls: DataFrame, sounds: DataFrame, key: str = "call_id", spoken: str = "spoken", candidates: str = "address_list", marks: str = PLACE_MARKS, introduction: str = INTRODUCTION) -> DataFrame:
    """``calls`` with ``clean``: the spoken text from where it begins to have a stretch in common with a candidate.

    A stretch in common begins with the first character that stands on the diagonal of a run that counts, so a word of
    which one syllable is wrong is not cut in two. What stands before goes only if it is no part of an address itself
    (``marks``); what stands behind stays. Without a stretch in common only an introduction goes.
    """
    line = Window.partitionBy("key", "cand", "diagonal")
    met = runs(calls, sounds, key, spoken, candidates).withColumn("_run", F.max(counts()).over(line)).where("_run")
    first = met.groupBy("key").agg(F.min("i").alias("_first"))
    out = calls.join(first.hint("merge"), F.col(key) == F.col("key"), "left")
    bare = F.regexp_replace(F.col(spoken), introduction, "")
    before = F.substring(F.col(spoken), F.lit(1), F.col("_first"))
    wrapped = F.coalesce(~before.rlike(marks), F.lit(False))
    return out.select(*[calls[c] for c in calls.columns], F.when(wrapped, F.substring(F.col(spoken), F.col("_first") + 1, F.length(spoken))).otherwise(bare).alias("clean"))
