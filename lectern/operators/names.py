"""Rule-based extraction of person names from conversations (conv_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utf16_length, utf16_prefix

# Sources of a name with their weights and labels.
WEIGHTS = {"speaker": 4, "self_intro": 5, "contact": 3, "title": 2, "english_self_intro": 5, "english_contact": 3}
LABELS = {"speaker": "说话人标记", "self_intro": "中文自我介绍", "contact": "中文联系/转接", "title": "称谓识别", "english_self_intro": "英文自我介绍", "english_contact": "英文联系/转接"}
# Surnames of two characters, and words that are no names.
COMPOUND = "欧阳 司马 上官 诸葛 东方 独孤 夏侯 尉迟 公孙 慕容 司徒 令狐 宇文 长孙 南宫 皇甫 轩辕 呼延 澹台 公冶 宗政 濮阳 淳于 单于 太叔 申屠".split()
STOP_CHINESE = "你好 您好 请问 谢谢 麻烦 可以 今天 明天 后天 下午 上午 晚上 现在 这个 那个 这里 这边 客服 客户 用户 同学 老师 经理 女士 先生 主任 老板 公司 系统 平台 团队 你们 我们 他们 大家 自己 情况 资料 流程 问题 需求 结果 面试 会议 电话 消息 一下 一位 一名 一份 收到 辛苦".split()
STOP_ENGLISH = "User Assistant Customer Agent System Support Manager Team Hello Thanks Thank Please Hr Admin Service".split()
#: Surnames of one character: the most frequent ones. Longer lists are given as a parameter.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"

# JavaScript's white space, and its word boundary; Java's differ on other alphabets.
_S = r"[\t\n\x0b\f\r    -     　﻿]"
_B = r"(?<![A-Za-z0-9_])"
_HAN = r"[一-龥]{2,4}"
_NAME = r"[A-Z][A-Za-z.'`-]*(?: [A-Z][A-Za-z.'`-]*){0,2}"
_TITLES = "老师|经理|医生|女士|先生|主任|总"
# The phrases that announce a name, in the order in which they are tried.
PATTERNS = (
    ("speaker", rf"^({_HAN})(?={_S}*[:：])"),
    ("self_intro", rf"(?:我是|我叫|名字叫|名字是|姓名是|本人是|这边是|这里是)({_HAN})"),
    ("contact", rf"(?:联系|找|咨询|转给|转接|请转|麻烦转给|发给)({_HAN})(?:{_TITLES})?"),
    ("contact", rf"(?:联系人|负责人|客户经理|接待老师)(?:[：:]|{_S})+({_HAN})"),
    ("title", rf"({_HAN})(?:{_TITLES})"),
    ("speaker", rf"^({_NAME})(?={_S}*[:：])"),
    ("english_self_intro", rf"{_B}(?:I am|I'm|my name is|My name is|This is){_S}+({_NAME})"),
    ("english_contact", rf"(?i){_B}(?:contact|find|ask for|transfer to|send to){_S}+({_NAME})"),
    ("english_contact", rf"(?:Contact|联系人|负责人)(?:[：:]|{_S})+({_NAME})"),
)


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{_S}+|{_S}+$", "")


def normalized(text: Column) -> Column:
    """One kind of line end, straight quotes, trimmed."""
    return trimmed(F.translate(F.regexp_replace(text, "\r\n?", "\n"), "“”‘’", "\"\"''"))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(normalized(text), "\n"), trimmed), lambda x: x != "")


def excerpt(line: Column) -> Column:
    return F.when(utf16_length(line) <= 96, line).otherwise(F.concat(utf16_prefix(line, 96), F.lit("...")))


def cleaned(x: Column) -> Column:
    return F.regexp_replace(trimmed(x), rf"""^(?:{_S}|["'`])+|(?:{_S}|["',.，。！？!?:：;；])+$""", "")


def english(x: Column) -> Column:
    """Words capitalised, also after a hyphen, apostrophe or backtick."""
    parts = F.filter(F.split(x, f"{_S}+"), lambda w: w != "")
    one = lambda w: F.array_join(F.transform(F.split(w, r"(?<=[-'`])|(?=[-'`])"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")
    return F.array_join(F.transform(parts, one), " ")


def valid_chinese(name: Column, surnames: str = SURNAMES) -> Column:
    fits = name.rlike(f"^{_HAN}$") & ~name.isin(STOP_CHINESE) & ~name.rlike(r"^(.)\1+$")
    return fits & (F.substring(name, 1, 2).isin(COMPOUND) | F.substring(name, 1, 1).isin(*surnames))


def valid_english(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z][A-Za-z.'`-]*(?: [A-Za-z][A-Za-z.'`-]*){0,2}$") & ~name.rlike(r"(?:^| ).(?: |$)") & ~name.isin(STOP_ENGLISH)


def hits(conversations: DataFrame, surnames: str = SURNAMES) -> DataFrame:
    """(conv_id, line, pattern, pos, source, name, excerpt): every valid match, in one pass over the text."""
    rows = conversations.select("conv_id", F.posexplode(lines(F.col("text"))).alias("line", "at"))
    tries = F.array(*[F.struct(F.lit(k).alias("pattern"), F.lit(source).alias("source"), F.regexp_extract_all("at", F.lit(p), 1).alias("found")) for k, (source, p) in enumerate(PATTERNS)])
    rows = rows.select("conv_id", (F.col("line") + 1).alias("line"), "at", F.explode(tries).alias("t"))
    rows = rows.select("conv_id", "line", "at", "t.pattern", "t.source", F.posexplode("t.found").alias("pos", "raw"))
    clean = cleaned(F.col("raw"))
    rows = rows.select("conv_id", "line", "pattern", "pos", "source", F.when(clean.rlike(r"[一-龥]"), clean).otherwise(english(clean)).alias("name"), excerpt(F.col("at")).alias("excerpt"))
    return rows.where(F.when(F.col("name").rlike(r"[一-龥]"), valid_chinese(F.col("name"), surnames)).otherwise(valid_english(F.col("name"))))


def confidence(score: Column, count: Column, introduced: Column) -> Column:
    return F.when((score >= 8) | (count >= 3) | introduced, "高").when((score >= 5) | (count >= 2), "中").otherwise("低")


def extract(conversations: DataFrame, surnames: str = SURNAMES) -> DataFrame:
    """(conv_id, name, count, score, confidence, sources, matches): sources and matches in order of appearance."""
    weight = F.element_at(F.create_map(*[F.lit(v) for kv in WEIGHTS.items() for v in kv]), F.col("source"))
    grouped = hits(conversations, surnames).groupBy("conv_id", "name").agg(
        F.count("*").cast("int").alias("count"), F.sum(weight).cast("int").alias("score"),
        F.max(F.col("source").isin("self_intro", "english_self_intro")).alias("introduced"),
        F.sort_array(F.collect_list(F.struct("line", "pattern", "pos", "source", "excerpt"))).alias("held"),
    )
    first = F.filter("held", lambda x, i: ~F.exists(F.slice("held", 1, i), lambda y: (y["line"] == x["line"]) & (y["source"] == x["source"])))
    matches = F.transform(first, lambda x: F.struct(x["line"].alias("line"), x["source"].alias("source"), x["excerpt"].alias("excerpt")))
    return grouped.select("conv_id", "name", "count", "score", confidence(F.col("score"), F.col("count"), F.col("introduced")).alias("confidence"), F.array_distinct(F.transform("held", lambda x: x["source"])).alias("sources"), matches.alias("matches"))


def ranked(found: DataFrame) -> DataFrame:
    """Names of each conversation by score, count, and name in Chinese collation."""
    return found.orderBy("conv_id", F.desc("score"), F.desc("count"), F.collate("name", "zh"))


def places(found: DataFrame) -> DataFrame:
    """``found`` with ``place``: a name's rank in its conversation, from 1, in the order of :func:`ranked`."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("count"), F.collate("name", "zh"))
    return found.withColumn("place", F.row_number().over(order))


def totals(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", F.size(lines(F.col("text"))).alias("total_lines"), utf16_length(normalized(F.col("text"))).alias("total_characters"))


def top_evidence(matches: Column, most: int = 3) -> Column:
    return F.slice(matches, 1, most)


def source_label(source: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in LABELS.items() for v in kv]), source)
