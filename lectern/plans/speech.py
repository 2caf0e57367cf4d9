"""Queries of spoken addresses by sound. The supplied tables hold no Chinese, so calls are derived from the customers' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prompts, reconcile, sounds
from .registry import query, spread

# Characters by the last digit but one and by the last digit of a key, homophones of the former, and their syllables.
_FIRST, _ALIKE, _SECOND = "安保成东方高海江兰明", "案堡城冬芳糕孩疆拦鸣", "林峰泉湖溪田桥石亭苑"
_SYLLABLES = ["an", "bao", "cheng", "dong", "fang", "gao", "hai", "jiang", "lan", "ming", "lin", "feng", "quan", "hu", "xi", "tian", "qiao", "shi", "ting", "yuan"]


def _readings(read) -> DataFrame:
    rows = list(zip(_FIRST + _SECOND, _SYLLABLES)) + list(zip(_ALIKE, _SYLLABLES)) + [("世", "shi"), ("四", "si"), ("新", "xin"), ("长", "zhang"), ("长", "chang"), ("常", "chang")]
    return read("customer").sparkSession.createDataFrame(rows, "char string, syllable string")


def _char(text: str, digit):
    return F.substring(F.lit(text), digit.cast("int") + 1, F.lit(1))


def _calls(read) -> DataFrame:
    """(call_id, kind, a, b, place, other) of customers: kind cycles over cases, a and b are characters of the key's digits."""
    n = F.col("c_custkey")
    tens = F.floor(n / 10) % 10
    rows = spread(read("customer").select("c_custkey"), 10_000).select(n.alias("call_id"), (F.floor(n / 100) % 6).cast("int").alias("kind"), _char(_FIRST, tens).alias("a"), _char(_ALIKE, tens).alias("alike"), _char(_FIRST, (tens + 5) % 10).alias("far"), _char(_SECOND, n % 10).alias("b"))
    return rows.withColumn("place", F.concat("a", "b", F.lit("世家")))


_DIGITS = f"""
WITH d AS (SELECT c_custkey AS call_id, (c_custkey // 100) % 6 AS kind, substr('{_FIRST}', (c_custkey // 10) % 10 + 1, 1) AS a, substr('{_ALIKE}', (c_custkey // 10) % 10 + 1, 1) AS alike,
  substr('{_FIRST}', (c_custkey // 10 + 5) % 10 + 1, 1) AS far, substr('{_SECOND}', c_custkey % 10 + 1, 1) AS b, a || b || '世家' AS place FROM customer)
"""


@query(_DIGITS + """
SELECT call_id, CASE kind WHEN 2 THEN far || b || '世家' WHEN 3 THEN alike || b || '世家3号楼' WHEN 5 THEN '三号楼常庄' ELSE place END AS corrected,
  CAST(CASE WHEN kind IN (1, 4, 5) THEN 1 ELSE 0 END AS INTEGER) AS n_changes, kind = 3 AS ambiguous FROM d
""")
def homophones(read):
    """Places as spoken: right, with a homophone, with another syllable, with two candidates that sound alike, with a confusable
    syllable, with a character of two readings behind a numeral."""
    rows = _calls(read)
    spoken = F.element_at(F.array("place", F.concat("alike", "b", F.lit("世家")), F.concat("far", "b", F.lit("世家")), F.concat("alike", "b", F.lit("世家3号楼")), F.concat("a", "b", F.lit("四家")), F.lit("三号楼长庄")), F.col("kind") + 1)
    second = F.when(F.col("kind") == 3, F.concat("alike", "b", F.lit("世家3号楼"))).when(F.col("kind") == 5, F.lit("3号楼常庄")).otherwise("九里")
    calls = rows.select("call_id", spoken.alias("spoken"), F.array(F.concat(F.lit("漳州市"), "place", F.lit("3号楼")), second).alias("address_list"))
    found = sounds.corrected(calls, sounds.sounding(_readings(read)))
    return found.select("call_id", "corrected", F.size("changes").alias("n_changes"), "ambiguous")


@query(_DIGITS + """
SELECT call_id, CASE kind WHEN 0 THEN place WHEN 1 THEN place WHEN 2 THEN place || '北门' WHEN 3 THEN '北门的' || place WHEN 4 THEN '一百楼一单元三零二' ELSE a || '留世家' END AS clean FROM d
""")
def address_wrappers(read):
    """Places with what people say around them: an introduction, other words before, words behind, a modifier, numbers, a wrong syllable."""
    rows = _calls(read)
    spoken = F.element_at(F.array(F.concat(F.lit("我住在"), "place"), F.concat(F.lit("宽又阔的"), "place"), F.concat("place", F.lit("北门")), F.concat(F.lit("北门的"), "place"), F.lit("一百楼一单元三零二"), F.concat("a", F.lit("留世家"))), F.col("kind") + 1)
    calls = rows.select("call_id", spoken.alias("spoken"), F.array(F.concat(F.lit("漳州市"), "place", F.lit("100号楼1单元302室"))).alias("address_list"))
    return sounds.cleaned(calls, sounds.sounding(_readings(read))).select("call_id", "clean")


@query(_DIGITS.replace("% 6", "% 10") + f"""
, t AS (SELECT *, a || b || '花园' AS garden, call_id % 9 + 1 AS n, call_id % 3 AS r FROM d),
o AS (SELECT *, CASE WHEN kind IN (0, 1) THEN 'matched_said' WHEN kind IN (2, 8) THEN 'refused' WHEN kind IN (3, 4, 6) THEN 'recorded' WHEN kind = 5 THEN 'agreed' WHEN kind = 7 THEN 'refused_broad' ELSE 'matched' END AS ruling,
  CASE kind WHEN 3 THEN n || '号楼30' || (r + 1) WHEN 4 THEN '云霄县' || garden WHEN 6 THEN garden || n || '栋' WHEN 5 THEN garden || n || '号楼' WHEN 7 THEN '北京市' WHEN 9 THEN '云霄县' || garden || n || '号楼30' || (r + 1) WHEN 2 THEN garden || n || '号楼309' WHEN 8 THEN garden || '77号楼301' ELSE garden || n || '号楼30' || (r + 1) END AS spoken FROM t)
SELECT call_id, ruling, CAST(CASE WHEN kind IN (0, 1, 9) THEN r WHEN kind = 5 THEN 1 ELSE -1 END AS INTEGER) AS matched_index, CAST(CASE WHEN kind IN (0, 1, 5, 9) THEN 1 ELSE 0 END AS INTEGER) AS match_count,
  CASE WHEN kind IN (2, 7, 8) THEN '请您提供正确完整的地址信息' WHEN kind = 9 THEN '请问您说的是' || spoken || '吗？' WHEN kind IN (0, 1, 5) THEN ''
    ELSE '我记录的地址信息是：' || spoken || '，' || CASE kind WHEN 3 THEN '请您再说一下具体的小区或村镇名称。' WHEN 4 THEN '请您再说一下具体的楼栋号、单元号及门牌号。' ELSE '请您再说一下具体的单元号及门牌号。' END END AS reply,
  CASE WHEN kind IN (0, 1, 5, 7, 9) THEN '__NO_MERGE__:' ELSE '' END || spoken AS next_text, CAST(CASE WHEN kind IN (3, 7) THEN 1 ELSE 0 END AS INTEGER) AS next_count FROM o
""")
def address_reconciled(read):
    """Ten meetings of a model's result with what the candidates say: it finds none, the wrong one, one whose room or building does not
    exist, one without a place, nothing for a follow-up, the right one, one of another building, and a fragment that is confirmed."""
    rows = _calls(read).withColumn("kind", (F.floor(F.col("call_id") / 100) % 10).cast("int"))
    n, r = (F.col("call_id") % 9 + 1).cast("string"), (F.col("call_id") % 3).cast("int")
    garden, none = F.concat("a", "b", F.lit("花园")), F.lit("")
    room = F.concat(F.lit("30"), (r + 1).cast("string"))
    full = F.concat(garden, n, F.lit("号楼"), room)
    case = lambda *values: F.element_at(F.array(*values), F.col("kind") + 1)
    said = case(full, full, F.concat(garden, n, F.lit("号楼309")), F.concat(n, F.lit("号楼"), room), garden, F.concat(garden, n, F.lit("号楼")), F.concat(garden, n, F.lit("栋")), F.lit("北京市"), F.concat(garden, F.lit("77号楼301")), F.concat(n, F.lit("号楼"), room))
    held = case(none, none, none, none, F.lit("云霄县"), none, none, none, none, F.concat(F.lit("云霄县"), garden))
    index = case(F.lit(-1), (r + 1) % 3, r, r, F.lit(-1), F.lit(1), F.lit(3), F.lit(-1), r, r)
    address = F.concat(F.lit("福建省漳州市云霄县"), garden)
    known = F.array(*[F.concat(address, n, F.lit(f"栋30{k}室")) for k in (1, 2, 3)], F.concat(address, F.lit("55栋301室")))
    fragment = F.when(F.col("kind") == 9, F.concat(garden, n, F.lit("栋"), room, F.lit("室")))
    model = F.struct(index.cast("int").alias("matched_index"), F.when(index >= 0, 1).otherwise(0).alias("match_count"), F.lit(False).alias("is_completed"), fragment.alias("matched_address_fragment"), F.lit(None).cast("string").alias("reason"))
    turns = rows.select(
        "call_id", model.alias("llm_result"), F.lit(False).alias("meaningless"), F.lit("matching").alias("state"), F.lit(-1).alias("matched_index"), said.alias("clean_user_input"), held.alias("last_unmatched_address"),
        F.lit("").alias("last_unmatched_fragment"), F.lit(0).alias("similar_no_match_count"), known.alias("address_list"),
    )
    found = reconcile.reconciled(turns)
    return found.select("call_id", "ruling", *[F.col(f"outcome.{c}") for c in ("matched_index", "match_count", "reply")], F.col("outcome.next_last_unmatched_address").alias("next_text"), F.col("outcome.next_similar_no_match_count").alias("next_count"))


@query(_DIGITS.replace("% 6", "% 5") + """
, t AS (SELECT *, a || b || '花园' AS garden, call_id % 9 + 1 AS n FROM d),
o AS (SELECT *, CASE kind WHEN 3 THEN '301' WHEN 4 THEN '南山公寓' ELSE garden END AS clean, CASE kind WHEN 0 THEN '' WHEN 1 THEN n || '号楼301' WHEN 2 THEN '云霄县' WHEN 3 THEN garden || n || '号楼30' ELSE garden END AS before,
  '漳州市' || garden || n || '号楼301' AS first FROM t),
m AS (SELECT *, CASE kind WHEN 1 THEN before || clean WHEN 3 THEN garden || n || '号楼301' ELSE '' END AS merged FROM o)
SELECT call_id, clean, CASE WHEN merged <> '' THEN merged ELSE clean END AS effective, merged, '漳州市' || garden AS base_address,
  'state=matching' || chr(10) || 'matched_index=-1' || chr(10) || 'clean_user_input=' || clean || chr(10) || CASE WHEN before <> '' THEN 'last_unmatched_address=' || before || chr(10) ELSE '' END
  || CASE WHEN kind = 2 THEN 'last_matched_address_fragment=云霄县' || chr(10) ELSE '' END
  || CASE WHEN merged <> '' THEN 'candidate_combined_user_scope_if_supplement=' || merged || chr(10) ELSE '' END || '本轮 User 只表示 clean_user_input，不包含上一轮内容。' || chr(10)
  || CASE WHEN before <> '' THEN '请先判断 clean_user_input 是对上一轮片段的补充还是重新说明；若是补充，不能只输出 clean_user_input 本轮片段，应输出合并后的片段。' || chr(10) ELSE '' END
  || CASE WHEN kind = 4 THEN '本轮地点主体校验：candidate_supports_current_anchor=false；matched_address_fragment 应按提示词中无候选支持或上一轮结果的规则处理。' || chr(10) ELSE '' END
  || 'candidates_info=[{"index": 0, "clean_address": "' || first || '", "base_address": "漳州市' || garden || '"}, {"index": 1, "clean_address": "云霄县九里路8号楼", "base_address": "云霄县九里路"}]' || chr(10)
  || 'clean_user_input: ' || clean || chr(10) || 'User: ' || clean AS message FROM m
""")
def address_messages(read):
    """What a model is asked: a place with an introduction, after its building and room, after a county of another candidate, a room that
    overlaps what was left open, a residence that no candidate has."""
    rows = _calls(read).withColumn("kind", (F.floor(F.col("call_id") / 100) % 5).cast("int"))
    n, garden = (F.col("call_id") % 9 + 1).cast("string"), F.concat("a", "b", F.lit("花园"))
    case = lambda *values: F.element_at(F.array(*values), F.col("kind") + 1)
    said = case(F.concat(F.lit("我住在"), garden), garden, garden, F.lit("301"), F.lit("南山公寓"))
    before = case(F.lit(""), F.concat(n, F.lit("号楼301")), F.lit(""), F.concat(garden, n, F.lit("号楼30")), garden)
    known = F.array(F.concat(F.lit("漳州市"), garden, n, F.lit("号楼301")), F.lit("云霄县九里路8号楼"))
    calls = rows.select("call_id", said.alias("user_input"), F.lit("matching").alias("state"), F.lit(-1).alias("matched_index"), before.alias("last_unmatched_address"), F.when(F.col("kind") == 2, "云霄县").alias("last_unmatched_fragment"), F.lit(0).alias("similar_no_match_count"), known.alias("address_list"))
    found = prompts.built(calls, sounds.sounding(_readings(read)))
    return found.select("call_id", F.col("built.clean_user_input").alias("clean"), F.col("built.effective_match_input").alias("effective"), F.col("built.possible_merged_input").alias("merged"), F.col("candidates_info")[0]["base_address"].alias("base_address"), F.col("built.user_message").alias("message"))
