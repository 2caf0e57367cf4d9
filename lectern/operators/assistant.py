"""Questions to a language model, and names in its answers. The model is a function that the caller gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, strip

# The request for names and the format of its answer.
PROMPT = """请从下面的对话文本中提取人物姓名。

要求：
1. 只提取真实姓名，不要提取职位、部门、组织、泛称或代词。
2. 去掉姓名后的称谓，例如“老师、经理、总、女士、先生”等。
3. 对重复姓名去重，但保留 1 到 3 条证据片段。
4. 如果无法确定是姓名，不要强行输出。
5. 如果没有识别到姓名，返回：{"names":[]}
6. 只返回合法 JSON，不要输出任何解释。

返回格式：
{
  "names": [
    {
      "name": "张敏",
      "confidence": "high",
      "reason": "说话人标签和自我介绍均命中",
      "evidence": ["张敏：你好，我是张敏，今天跟你确认面试时间。"]
    }
  ]
}"""
PAYLOAD = "struct<names: array<struct<name: string, confidence: string, reason: string, evidence: array<string>>>>"


def prompt(conversation: Column) -> Column:
    return F.concat(F.lit(PROMPT + "\n\n对话文本：\n"), conversation, F.lit("\n\n请只返回 JSON。"))


def call_id(at_ms: Column, token: Column) -> Column:
    return F.concat(F.lit("name_"), at_ms.cast("string"), F.lit("_"), token)


def request_error(call: Column, content: Column, has_key: Column) -> Column:
    """The first thing that is wrong with a request, or null."""
    return F.when(blank(call), "callId is required").when(blank(content), "content is required").when(~has_key, "ALIAI_API_KEY is not configured")


def status(error: Column, kind: Column) -> Column:
    """HTTP status of an outcome by the kind of its error: value, runtime, or any other."""
    return F.when(error.isNull(), 200).when(kind == "value", 400).when(kind == "runtime", 500).otherwise(502)


def answer_text(text: Column, parts: Column) -> Column:
    """A plain answer, trimmed, or the non-blank parts of one in pieces, one a line."""
    joined = F.array_join(F.filter(F.transform(parts, strip), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
    return F.when(text.isNotNull(), strip(text)).otherwise(F.coalesce(strip(joined), F.lit("")))


def ask(requests: DataFrame, model: Callable[[str], object], has_key: bool = True) -> DataFrame:
    """(callId, answer, error, status) of ``requests`` (callId, content); ``model`` runs on the executors.

    ``model`` returns a text or a list of texts and dictionaries with a text; what it raises is a 502.
    """
    checked = requests.select(strip(F.col("callId")).alias("callId"), strip(F.col("content")).alias("content"), request_error(F.col("callId"), F.col("content"), F.lit(has_key)).alias("error"))

    def run(frames):
        for frame in frames:
            answers, errors, codes = [], [], []
            for content, error in zip(frame["content"], frame["error"]):
                answer, code = None, 200
                if error is not None:
                    code = 500 if "configured" in error else 400
                else:
                    try:
                        value = model(content)
                        parts = [value] if isinstance(value, str) else [x.get("text") if isinstance(x, dict) else x for x in value or []]
                        answer = "\n".join(x.strip() for x in parts if isinstance(x, str) and x.strip())
                        if not answer:
                            answer, error, code = None, "AI returned an empty answer", 500
                    except Exception as e:
                        error, code = str(e), 502
                answers.append(answer)
                errors.append(error)
                codes.append(code)
            yield frame[["callId"]].assign(answer=answers, error=errors, status=codes)

    return checked.mapInPandas(run, "callId string, answer string, error string, status int")


def latest(calls: DataFrame) -> DataFrame:
    """(callId, content): the last content of each call by ``at``."""
    return calls.groupBy("callId").agg(F.max_by("content", "at").alias("content"))


def json_text(answer: Column) -> Column:
    """What stands in the first fence of an answer, or all of it."""
    fenced = F.regexp_extract(answer, r"(?is)```(?:json)?\s*(.*?)```", 1)
    return strip(F.when(fenced != "", fenced).otherwise(answer))


def payload(answer: Column) -> Column:
    """The names in an answer as an array of structs; null if it is no JSON object with an array of names."""
    value = F.try_parse_json(json_text(answer))
    is_list = F.schema_of_variant(F.try_variant_get(value, "$.names", "variant")).startswith("ARRAY")
    return F.when(is_list, F.from_json(F.to_json(value), PAYLOAD)["names"])


def chinese_confidence(x: Column) -> Column:
    low = F.lower(strip(x))
    return F.when(x.isNull() | (x == ""), "未知").when(low == "high", "高").when(low == "medium", "中").when(low == "low", "低").otherwise(x)


def names(answers: DataFrame) -> DataFrame:
    """(call_id, pos, name, confidence, reason, evidence): the named entries of each answer; evidence holds three at most."""
    rows = answers.select("call_id", F.posexplode(payload(F.col("answer"))).alias("pos", "x"))
    rows = rows.where(~blank(F.col("x.name")))
    return rows.select("call_id", "pos", F.col("x.name").alias("name"), chinese_confidence(F.col("x.confidence")).alias("confidence"), F.col("x.reason").alias("reason"), F.slice(F.coalesce("x.evidence", F.array().cast("array<string>")), 1, 3).alias("evidence"))
