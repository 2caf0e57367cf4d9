"""What a model is asked about one turn of a spoken address: the texts that count, the candidates, and the message.

The caller's words lose what is no address (:mod:`sounds`), homophones are corrected to the candidates, and what an earlier turn
left open joins in if one candidate explains both, or if the two overlap in a text that one explains. Where two candidates sound
alike nothing is joined. The message is text; all that it is made of is also there as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from . import reconcile, sounds
from .address import NO_MERGE

# A room at an address's end with all that leads to it, and words that name a residence.
DETAIL = "(?:(?:[A-Za-z]?[0-9]+|[零〇一二三四五六七八九十百千两幺]+|[A-Za-z](?=[座栋幢]))(?:号楼|栋|幢|楼|座|号|单元|层|室|房)?)+$"
RESIDENCE = "(?:小区|花园|家园|公寓|新村|新城|大厦|华府|名著)$"
# Parts of the message.
ONLY_THIS = "本轮 User 只表示 clean_user_input，不包含上一轮内容。"
JUDGE = "请先判断 clean_user_input 是对上一轮片段的补充还是重新说明；若是补充，不能只输出 clean_user_input 本轮片段，应输出合并后的片段。"
UNSUPPORTED = "本轮地点主体校验：candidate_supports_current_anchor=false；matched_address_fragment 应按提示词中无候选支持或上一轮结果的规则处理。"
ALIKE = "根据拼音(多音字)发现用户片段与候选片段相近: "
FIELDS = ("clean_user_input", "llm_user_input", "effective_match_input", "possible_merged_input", "user_message", "history_user_message")


def base_address(address: Column) -> Column:
    """An address without building, unit and room."""
    return F.regexp_replace(address, DETAIL, "")


def candidates_info(addresses: Column) -> Column:
    """array<struct<index, clean_address, base_address>>; nulls count as empty."""
    clean = lambda c: F.coalesce(strip(c), F.lit(""))
    return F.transform(F.coalesce(addresses, F.array().cast("array<string>")), lambda c, i: F.struct(i.alias("index"), clean(c).alias("clean_address"), base_address(clean(c)).alias("base_address")))


def _quoted(x: Column) -> Column:
    # The JSON text of an array of the one string, without its brackets.
    return F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")


def candidates_json(info: Column) -> Column:
    one = lambda c: F.concat(F.lit('{"index": '), c["index"].cast("string"), F.lit(', "clean_address": '), _quoted(c["clean_address"]), F.lit(', "base_address": '), _quoted(c["base_address"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(info, one), ", "), F.lit("]"))


def near_misses(calls: DataFrame, heard: DataFrame, key: str = "call_id", spoken: str = "spoken", candidates: str = "address_list") -> DataFrame:
    """(key, misses): the single characters within a stretch that a candidate else has, whose syllables differ, as ``said(syllable)≠meant(syllable)``."""
    line = Window.partitionBy("key", "cand", "diagonal")
    found = sounds.runs(calls, heard, key, spoken, candidates).withColumns({"held": F.max(sounds.counts()).over(line), "next": F.lead("i").over(line.orderBy("i"))})
    gaps = found.where(F.col("held") & (F.col("next") == F.col("i") + 2)).select("key", "cand", (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"))
    texts = calls.select(F.col(key).alias("key"), F.col(spoken).alias("_spoken"), F.col(candidates).alias("_known"))
    letter = lambda text, at: F.substring(text, at + 1, F.lit(1))
    gaps = gaps.join(texts.hint("merge"), "key").select("key", letter(F.col("_spoken"), F.col("i")).alias("said"), letter(F.get("_known", F.col("cand")), F.col("j")).alias("meant")).distinct()
    syllables = heard.select("char", F.array_join(F.array_sort("syllables"), "/").alias("sound"))
    of = lambda x: F.broadcast(syllables.select(F.col("char").alias(x), F.col("sound").alias(f"{x}_sound")))
    gaps = gaps.join(of("said"), "said").join(of("meant"), "meant")
    shown = F.concat("said", F.lit("("), "said_sound", F.lit(")≠"), "meant", F.lit("("), "meant_sound", F.lit(")"))
    return gaps.groupBy("key").agg(F.array_sort(F.collect_set(shown)).alias("misses"))


def built(calls: DataFrame, heard: DataFrame, key: str = "call_id") -> DataFrame:
    """``calls`` (user_input, state, matched_index, last_unmatched_address, last_unmatched_fragment, similar_no_match_count, address_list, ...)
    with ``built`` (FIELDS), ``candidates_info``, ``supported`` (some candidate has what was said) and ``misses``.

    ``heard`` is :func:`sounds.sounding`'s table; ``key`` tells the rows apart, and rows without one are taken as they were said.
    """
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    names = calls.columns
    own = calls.select(F.struct(*names).alias("_row"), F.col(key).alias("call_id"), text("user_input").alias("spoken"), "address_list")
    own = sounds.cleaned(own, heard)
    own = sounds.corrected(own, heard, spoken="clean")
    own = own.join(near_misses(own, heard, spoken="clean").hint("merge"), F.col("call_id") == F.col("key"), "left").drop("key")
    held = lambda c: F.regexp_replace(F.coalesce(strip(F.col("_row")[c]), F.lit("")), r"[，。,.;；:：]+$", "")
    fragment = held("last_unmatched_fragment") if "last_unmatched_fragment" in names else F.lit("")
    closed = held("last_unmatched_address").startswith(NO_MERGE)
    own = own.withColumns({"fragment": fragment, "before": F.when(closed, "").when(fragment != "", fragment).otherwise(held("last_unmatched_address")), "info": candidates_info(F.col("address_list"))})
    plain = F.transform("info", lambda c: reconcile.canonical(c["clean_address"]))
    own = own.withColumn("plain", plain).withColumns({"known": F.transform("plain", reconcile.marked), "region_texts": F.lit(None).cast("array<string>")})
    now = reconcile.Read(own, "corrected")
    past = reconcile.Read(now.frame, "before")
    own = past.frame.withColumn("joined", reconcile.merged(F.col("before"), F.col("corrected")))
    both = reconcile.Read(own, "joined")
    overlap = F.length("joined") < F.length("before") + F.length("corrected")
    together = (F.size(F.array_intersect(now.own, past.own)) > 0) | overlap & (F.size(both.own) > 0)
    merged = F.when((F.col("before") != "") & ~F.col("ambiguous") & together, F.col("joined")).otherwise("")
    own = both.frame.withColumns({"merged": merged, "supported": F.size(now.own) > 0, "misses": F.coalesce("misses", F.array().cast("array<string>"))})
    effective = F.when(F.col("merged") != "", F.col("merged")).otherwise(F.col("corrected"))
    row = F.col("_row")
    anchor = F.col("clean").rlike(RESIDENCE) & ~F.col("supported")

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        shown = F.concat(F.lit(name), value)
        return shown if when is None else F.when(when, shown)

    shown = F.coalesce(row["state"], F.lit(""))
    parts = [
        line("state=", shown), line("matched_index=", F.coalesce(row["matched_index"], F.lit(-1)).cast("string")), line("clean_user_input=", F.col("clean")),
        line("last_unmatched_address=", F.col("before"), F.col("before") != ""), line("last_matched_address_fragment=", F.col("fragment"), F.col("fragment") != ""),
        line("candidate_combined_user_scope_if_supplement=", F.col("merged"), F.col("merged") != ""), F.lit(ONLY_THIS), F.when(F.col("before") != "", F.lit(JUDGE)),
        line(ALIKE, F.concat("clean", F.lit("~"), "corrected"), F.col("clean") != F.col("corrected")), line("不同音节，不作纠正: ", F.array_join("misses", "，"), F.size("misses") > 0),
        F.when(anchor, F.lit(UNSUPPORTED)), line("candidates_info=", candidates_json(F.col("info"))), line("clean_user_input: ", F.col("clean")), line("User: ", F.col("clean")),
    ]
    values = (F.col("clean"), F.col("clean"), effective, F.col("merged"), F.concat_ws("\n", *parts), F.concat(F.lit("User: "), "clean"))
    return own.select("_row.*", F.struct(*[v.alias(c) for v, c in zip(values, FIELDS)]).alias("built"), F.col("info").alias("candidates_info"), "supported", "misses")
