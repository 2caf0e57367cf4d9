"""A model's result for a spoken address against what the candidates themselves say.

Texts are read into parts by column expressions: regions, roads, named places, areas of a place, and numbers
(building, unit, room). Numbers are whole tokens between marks, so a candidate explains a text if it holds all of its marked parts, in
whatever order they were said. What the model found, what the rules find and how the two conflict meet in one
decision table (:func:`ruling`); the model's own reply is never used. Each row is decided by itself, without a shuffle.

The rules are known from recorded examples; tests hold all that this operator follows, and name those that contradict
one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, strip
from .address import NO_MERGE

# What the system says.
SAY_PLACE = "请您再说一下具体的小区或村镇名称。"
SAY_LAYER = "好的，请您再说一下具体的小区或村镇名称。"
SAY_BUILDING = "请您再说一下具体的楼栋号、单元号及门牌号。"
SAY_UNIT = "请您再说一下具体的单元号及门牌号。"
SAY_ROOM = "请您再提供下门牌号信息"
GIVE_BUILDING = "请您再提供下楼栋号、单元号及门牌号信息"
GIVE_PLACE = "请您再提供下小区名称或楼宇名称"
SAY_CORRECT = "请您提供正确完整的地址信息"
SAY_DETAIL = "请您提供详细的地址信息"
ASK_DETAIL = "请你提供详细的地址信息"
YES = "^(?:是的?|对的?|嗯+|没错|正确|好的?|可以|就是|确认|对对+|是是+)[啊呀吧呢了的。，,!！ ]*$"
NO = "^(?:不是|不对|错了|不正确|说错|没有|不是的|不对的)"
NUMERALS, FIGURES, TENS = "零〇一二三四五六七八九两幺", "0012345678921", "十百千"
WIDE = "".join(chr(c + 0xFEE0) for c in range(33, 127))
NARROW = "".join(chr(c) for c in range(33, 127))
REGION = r"[一-鿿]{1,8}?(?:省|自治区|市|县|(?<![东西南北])区(?!域)|镇|乡|街道|村)"
ROAD = r"[一-鿿]{1,8}?(?:路|街|巷|大道|胡同)"
NUMBER = r"[A-Za-z]?\d+(?:#|单元)?"
AREA = "[东西南北]区"
PLACE = rf"[一-鿿A-Za-z]+?(?={ROAD}|[A-Za-z]?\d|{AREA}|$)"
PLACE_WORDS = "(?:小区|花园|家园|公寓|大厦|国际|园区|社区|工厂|广场|新村)$"
MARK = "\x01"
#: Repeats without progress after which a call has failed.
PATIENCE = 3


def number(token: Column) -> Column:
    """The figures of a Chinese numeral: by tens, hundreds and thousands where it names them, else digit by digit."""
    figures = F.translate(token, NUMERALS, FIGURES)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"), F.lit(True).alias("first"))

    def add(held: Column, c: Column) -> Column:
        unit = F.when(c == "十", 10).when(c == "百", 100).when(c == "千", 1000)
        alone = F.when(held["first"] & (held["now"] == 0), 1).otherwise(held["now"])
        return F.when(unit.isNull(), F.struct(held["total"].alias("total"), F.try_to_number(c, F.lit("9")).cast("int").alias("now"), held["first"].alias("first"))).otherwise(F.struct((held["total"] + alone * unit).alias("total"), F.lit(0).alias("now"), F.lit(False).alias("first")))

    value = F.aggregate(F.filter(F.split(figures, ""), lambda c: c != ""), start, add, lambda held: (held["total"] + held["now"]).cast("string"))
    return F.when(token.rlike(f"[{TENS}]"), value).otherwise(figures)


def canonical(x: Column) -> Column:
    """Half-width, without punctuation, numbers in figures where one is meant, one sign (#) for a building, none for a room."""
    bare = F.regexp_replace(F.translate(x, WIDE, NARROW), r"[\s,.。、:;!?，；：！？]+", "")
    tokens = F.regexp_extract_all(bare, F.lit(f"[{NUMERALS}{TENS}]+|[^{NUMERALS}{TENS}]+"), 0)

    def figure(held: Column) -> Column:
        def one(token: Column, i: Column) -> Column:
            after = F.coalesce(F.get(held, i + 1), F.lit(""))
            meant = after.rlike("^(?:号楼|栋|幢|楼|号|单元|室|层|座|房)") | (F.length(token) > 2) | (F.length(token) > 1) & ((after == "") | after.rlike(r"^\d"))
            return F.when(token.rlike(f"^[{NUMERALS}{TENS}]") & meant, number(token)).otherwise(token)

        return F.array_join(F.transform(held, one), "")

    text = bound(tokens, figure)
    text = F.regexp_replace(text, r"(?<=\d)(?:号楼|号院|栋|幢|楼|座|号)", "#")
    return F.regexp_replace(text, r"(?<=\d)(?:室|房)", "")


def marked(x: Column) -> Column:
    """A canonical text with marks around each number."""
    return F.regexp_replace(x, f"({NUMBER})", f"{MARK}$1{MARK}")


def parts(x: Column) -> Column:
    """array<struct<kind, value>> of a canonical text, values with marks around their numbers."""
    found = F.regexp_extract_all(x, F.lit(rf"{REGION}|{ROAD}(?:\d+#)?|{NUMBER}|{AREA}|{PLACE}|."), 0)

    def kind(v: Column) -> Column:
        named = F.when(v.rlike(PLACE_WORDS), "place")
        return named.when(v.rlike(f"^{AREA}$"), "area").when(v.rlike(f"^(?:{REGION})$"), "region").when(v.rlike(rf"^(?:{ROAD})(?:\d+#)?$"), "road").when(v.endswith("#"), "building").when(v.endswith("单元"), "unit").when(v.rlike(r"\d$"), "room").when(F.length(v) > 1, "place").otherwise("other")

    return F.transform(found, lambda v: F.struct(kind(v).alias("kind"), marked(v).alias("value")))


def explained(parts_: Column, candidate: Column) -> Column:
    """Whether the marked canonical ``candidate`` holds all parts; no parts are not explained."""
    return (F.size(parts_) > 0) & F.forall(parts_, lambda p: F.call_function("instr", candidate, p["value"]) > 0)


def matching(parts_: Column, candidates: Column) -> Column:
    """The places, from 0, of the candidates that explain the parts."""
    return F.filter(F.transform(candidates, lambda c, i: F.when(explained(parts_, c), i)), lambda i: i.isNotNull())


def merged(before: Column, now: Column) -> Column:
    """``before`` and ``now`` with the longest overlap of end and start said once; one that holds the other stands for both."""
    longest = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(before), F.length(now))), lambda k: F.call_function("right", before, k) == F.call_function("left", now, k)))
    return F.when(F.call_function("instr", before, now) > 0, before).when(F.call_function("instr", now, before) > 0, now).otherwise(F.concat(before, F.call_function("substring", now, longest + 1)))


def _has(kinds: Column, *names: str) -> Column:
    return F.arrays_overlap(kinds, F.array(*map(F.lit, names)))


def _only(kinds: Column, *names: str) -> Column:
    return (F.size(kinds) > 0) & (F.size(F.array_except(kinds, F.array(*map(F.lit, names)))) == 0)


class Read:
    """What a text column says: its parts and kinds against the candidates (marked canonical texts and their regions)."""

    def __init__(self, frame: DataFrame, name: str, known: str = "known", regions: str = "region_texts"):
        self.name = name
        value = strip(F.col(name))
        frame = frame.withColumn(f"{name}_raw", parts(canonical(value)))
        # A word that candidates have within a region's name, and in no place's, is a region said without its suffix.
        inside = lambda v: F.exists(F.coalesce(regions, F.array().cast("array<string>")), lambda r: F.call_function("instr", r, v) > 0)
        frame = frame.withColumn(f"{name}_parts", F.transform(f"{name}_raw", lambda p: F.struct(F.when((p["kind"] == "place") & inside(p["value"]), "region").otherwise(p["kind"]).alias("kind"), p["value"].alias("value"))))
        self.frame = frame.withColumn(f"{name}_kinds", F.array_distinct(F.transform(f"{name}_parts", lambda p: p["kind"]))).withColumn(f"{name}_own", matching(F.col(f"{name}_parts"), F.col(known)))
        self.parts, self.kinds, self.own = F.col(f"{name}_parts"), F.col(f"{name}_kinds"), F.col(f"{name}_own")
        self.village = F.exists(self.parts, lambda p: (p["kind"] == "region") & p["value"].endswith("村"))
        self.place = _has(self.kinds, "place") | self.village
        #: Enough to find a flat by: a place, or a road with a room.
        self.anchored = self.place | _has(self.kinds, "road") & _has(self.kinds, "room")
        self.detailed = _has(self.kinds, "room") | F.array_contains(self.kinds, "building") & F.array_contains(self.kinds, "unit")
        self.precise = self.place & self.detailed
        self.broad = _only(self.kinds, "region")
        self.numbers = _only(self.kinds, "building", "unit", "room")
        self.flat = canonical(value).rlike(rf"(?:路|街|巷|大道|胡同)\d+#") & value.rlike("(?:号楼|栋|幢|楼|座)$")

    @property
    def ask(self) -> Column:
        """What is missing after this text."""
        building = F.when(_only(self.kinds, "place"), GIVE_BUILDING).otherwise(SAY_BUILDING)
        place = F.when(~_has(self.kinds, "building"), building).when(~_has(self.kinds, "unit", "room"), SAY_UNIT).otherwise(SAY_ROOM)
        return F.when(self.place, place).when(self.flat, SAY_ROOM).otherwise(SAY_PLACE)

    @property
    def reason(self) -> Column:
        """one: the place is missing, two: building and room are missing, empty: it is no place; the match itself is told by the caller."""
        return F.when(self.place & ~_has(self.kinds, "building", "room"), "two").when(~self.place & _has(self.kinds, "building", "room") & ~_has(self.kinds, "road"), "one").otherwise("")


def _recorded(text: Column, ask: Column) -> Column:
    return F.concat(F.lit("我记录的地址信息是："), text, F.lit("，"), ask)


def _confirm(text: Column) -> Column:
    return F.concat(F.lit("请问您说的是"), text, F.lit("吗？"))


MODEL = "struct<matched_index: int, match_count: int, is_completed: boolean, matched_address_fragment: string, reason: string>"
FIELDS = ("matched_index", "match_count", "is_completed", "is_extract_failed", "matched_address_fragment", "reason", "reply", "ai_context_reply", "next_last_unmatched_address", "next_last_unmatched_fragment", "next_similar_no_match_count")


def _prepared(turns: DataFrame) -> tuple[DataFrame, Read, Read, Read, Read]:
    """``turns`` with what the decision needs: the texts said, carried and merged, and the model's fragment, each read against the candidates."""
    model = F.col("llm_result")
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    restart = text("state") == "completed"
    frame = turns.select(
        "*", F.when(text("state") == "", "matching").otherwise(text("state")).alias("now"), F.regexp_replace(text("clean_user_input"), r"[，。,.;；:：!！?？]+$", "").alias("said"),
        F.when(restart, "").otherwise(F.regexp_replace(F.regexp_replace(text("last_unmatched_address"), f"^{NO_MERGE}", ""), r"[，。,.;；:：]+$", "")).alias("held"),
        (text("last_unmatched_address").startswith(NO_MERGE) | restart).alias("closed"),
        text("last_unmatched_fragment").alias("held_fragment"), F.when(restart, 0).otherwise(F.coalesce("similar_no_match_count", F.lit(0))).alias("count"),
        F.coalesce(model["matched_index"], F.lit(-1)).alias("model_index"), F.coalesce(model["match_count"], F.lit(0)).alias("model_count"),
        model["matched_address_fragment"].isNotNull().alias("speaks"), F.coalesce(strip(model["matched_address_fragment"]), F.lit("")).alias("fragment"),
        F.coalesce(strip(model["reason"]), F.lit("")).alias("model_reason"), F.transform(F.coalesce("address_list", F.array().cast("array<string>")), lambda c: canonical(F.coalesce(c, F.lit("")))).alias("plain"),
    )
    held_open = F.when(F.col("closed"), "").otherwise(F.col("held"))
    frame = frame.withColumns({"known": F.transform("plain", marked), "region_texts": F.transform("plain", lambda c: F.array_join(F.transform(F.filter(parts(c), lambda p: p["kind"] == "region"), lambda p: p["value"]), MARK)), "open": held_open})
    said = Read(frame, "said")
    before = Read(said.frame, "open")
    frame = before.frame
    # Numbers that were said first stand behind the place that follows them.
    joined = F.when(before.numbers & ~said.numbers & ~F.col("said").contains(F.col("open")), merged(F.col("said"), F.col("open"))).otherwise(merged(F.col("open"), F.col("said")))
    # An area alone, as a district's east, yields to a place.
    together = (F.size(F.array_intersect(said.own, before.own)) > 0) & ~(_only(before.kinds, "area") & said.place)
    frame = frame.withColumn("both", F.when((F.col("open") != "") & together, joined).otherwise(F.col("said")))
    both = Read(frame, "both")
    fragment = Read(both.frame, "fragment")
    return fragment.frame, said, before, both, fragment


def ruling(said: Read, before: Read, both: Read, fragment: Read) -> Column:
    """The decision table: one name for each combination of state, model outcome, rule outcome and conflict, in order of precedence.

    Conflicts of a model's unique match: no place was said (``unanchored``), a number is not the candidate's (``number``).
    """
    state, sentence, unique = F.col("now"), F.col("said"), (F.col("model_count") == 1) & (F.col("model_index") >= 0)
    chosen = F.get("known", F.greatest("model_index", F.lit(0)))
    numbers = F.filter(both.parts, lambda p: p["kind"].isin("building", "unit", "room"))
    conflict = ~F.coalesce(F.forall(numbers, lambda p: F.call_function("instr", chosen, p["value"]) > 0), F.lit(False))
    reused = (F.col("fragment") != "") & ((F.col("fragment") == F.col("held_fragment")) | (F.col("fragment") == F.col("held"))) & (F.size(said.own) == 0)
    supported = F.size(said.own) > 0
    return (
        F.when((state == "confirming") & sentence.rlike(YES), "completed")
        .when((state == "confirming") & sentence.rlike(NO), "denied")
        .when((state == "completed") & sentence.rlike(NO), "restarted")
        # The model gives a fragment that it gave before.
        .when(reused & F.coalesce("meaningless", F.lit(False)), "failed_counted")
        .when(reused & fragment.place & said.place, "dropped")
        .when(reused, "kept")
        .when(F.col("speaks") & (F.col("fragment") == ""), F.when(F.col("open") != "", "repeated").otherwise("unsupported"))
        # The rules know better than the model.
        .when(said.precise & (F.size(said.own) == 1), "matched_said")
        .when(said.precise & (F.size(said.own) == 0), "refused")
        .when(both.anchored & both.detailed & (F.size(both.own) == 1), "matched")
        # The model's unique match holds unless it conflicts.
        .when(unique & both.anchored & _has(both.kinds, "building", "room") & ~conflict, "agreed")
        .when((F.col("model_count") > 1) & supported, "several")
        .when(supported, "recorded")
        # Nothing said is in a candidate.
        .when(said.broad & (F.size("known") == 0), "recorded")
        .when(said.broad & F.col("closed") & (F.col("held") != ""), "failed")
        .when(said.broad & (F.col("open") != "") & (F.size(before.own) == 0), "cleared")
        .when(said.broad, "refused_broad")
        .when(F.col("count") + 1 >= PATIENCE, "failed")
        .when(F.col("open") != "", "repeated")
        .otherwise("unsupported")
    )


def reconciled(turns: DataFrame) -> DataFrame:
    """``turns`` (llm_result MODEL, meaningless, state, clean_user_input, last_unmatched_address, last_unmatched_fragment,
    similar_no_match_count, address_list, ...) with ``ruling`` and ``outcome`` (FIELDS).

    A null or missing model result is one that found nothing. With a fragment (null: the model does not give any) replies confirm
    and name the fragment to the model; without one a match has no reply.
    """
    frame, said, before, both, fragment = _prepared(turns)
    frame = frame.withColumn("ruling", ruling(said, before, both, fragment))
    case = lambda *names: F.col("ruling").isin(*names)
    match = case("matched", "matched_said", "agreed")
    text = F.when(case("matched_said", "refused"), F.col("said")).when(case("kept", "repeated"), F.col("held")).otherwise(F.col("both"))
    index = F.when(case("matched_said"), F.get(said.own, F.lit(0))).when(case("matched"), F.get(both.own, F.lit(0))).when(case("agreed"), F.col("model_index")).when(case("completed"), F.greatest(F.col("matched_index"), F.col("model_index"))).otherwise(-1)
    count = F.when(match | case("completed"), 1).when(case("several"), F.col("model_count")).otherwise(0)
    # A fragment's reason is the rules'; what to ask for follows it only where the model gave one itself.
    found = F.when(match, "true").otherwise(fragment.reason)
    gone = case("completed", "denied", "restarted", "failed", "failed_counted", "dropped", "cleared")
    reason = F.when(~F.col("speaks") | gone | (F.col("fragment") == ""), "").otherwise(found)
    asked = F.when(F.col("speaks") & (F.col("model_reason") != "") & (found == "one"), GIVE_PLACE).when(F.col("speaks") & (F.col("model_reason") != "") & (found == "two"), GIVE_BUILDING)
    ask = F.coalesce(asked, F.when(case("repeated"), before.ask).otherwise(both.ask))
    ask = F.when(case("kept"), F.when(found == "one", GIVE_PLACE).otherwise(GIVE_BUILDING)).otherwise(ask)

    def reply(of: Column) -> Column:
        return (
            F.when(match, F.when(F.col("speaks"), _confirm(of)).otherwise("")).when(case("recorded", "several", "kept", "repeated"), _recorded(of, ask))
            .when(case("denied", "dropped"), SAY_DETAIL).when(case("restarted"), SAY_LAYER).when(case("refused", "refused_broad"), SAY_CORRECT)
            .when(case("unsupported"), F.when(F.col("speaks"), ASK_DETAIL).otherwise(SAY_DETAIL)).otherwise("")
        )

    candidate = F.when(F.col("fragment") != "", F.col("fragment")).otherwise(F.when(match, F.get("address_list", index)).otherwise(text))
    named = F.exists(both.name + "_raw", lambda p: p["kind"].isin("place", "road", "area"))
    spoken_only = F.when(both.place | named, 0).when(F.array_contains(both.kinds, "unit") & _has(both.kinds, "room"), 0)
    first = F.when(F.col("open") == "", F.col("count") + 1).when(F.col("said").contains(F.col("open")) & both.numbers, F.col("count")).otherwise(0)
    next_count = F.when(case("recorded"), F.coalesce(spoken_only, first)).when(case("repeated", "refused_broad", "unsupported", "failed_counted"), F.col("count") + 1).otherwise(0)
    next_text = F.when(match, F.concat(F.lit(NO_MERGE), text)).when(case("refused_broad"), F.concat(F.lit(NO_MERGE), F.col("said"))).when(case("recorded", "several", "kept", "repeated", "refused"), text).otherwise("")
    next_fragment = F.when(case("recorded", "several", "kept", "matched", "matched_said", "agreed"), F.col("fragment")).otherwise("")
    values = (index, count, case("completed"), case("failed", "failed_counted"), F.when(gone, "").otherwise(F.col("fragment")), reason, reply(text), reply(candidate), next_text, next_fragment, next_count.cast("int"))
    return frame.select(*turns.columns, "ruling", F.struct(*[F.coalesce(v, F.lit("")).alias(c) if c.startswith(("next_last", "reply", "ai_", "reason", "matched_address")) else v.alias(c) for v, c in zip(values, FIELDS)]).alias("outcome"))
