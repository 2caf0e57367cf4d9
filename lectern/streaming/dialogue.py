"""Streams: address dialogues with state per call, the last content of each call, and files as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.address import CARRIED, OUTCOME, step

STATE = "state string, matched_index int, last_unmatched_address string, last_unmatched_fragment string, similar_no_match_count int"
RESULT = "call_id string, turn long, user_input string, " + OUTCOME.removeprefix("struct<").removesuffix(">").replace(":", "")
FILE = "path string, modificationTime timestamp, length long, content binary"


def address_dialogue(turns: DataFrame, idle_ms: int | None = 3_600_000) -> DataFrame:
    """The outcome of each turn of a stream (call_id, turn, user_input, address_list).

    A call's carried fields are its state; it goes when the call has been idle for ``idle_ms`` (None: never). Turns of one
    call that arrive in one batch are taken in their order.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(CARRIED, state.get)) if state.exists else {}
        rows = []
        for r in pd.concat(list(frames)).sort_values("turn").to_dict("records"):
            out = step(r | held)
            held = {k: out[k] for k in CARRIED}
            rows.append({"call_id": key[0], "turn": r["turn"], "user_input": r["user_input"], **out})
        state.update(tuple(held[k] for k in CARRIED))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows)

    return turns.groupBy("call_id").applyInPandasWithState(run, RESULT, STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


#: What :class:`Dialogue` needs of the session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ORDERED = RESULT + ", late boolean"


class Dialogue(StatefulProcessor):
    """Turns of a call in their order, also where they arrive out of it.

    A turn is taken when the one before it has been; one that comes early waits, in a map by turn, until the gap is filled or
    ``grace_ms`` have passed since the last arrival, and then the least that waits goes on. A turn that arrives after a later one
    has been taken is given back as late, without an outcome; a turn that was taken already is dropped. When a call has
    been idle for ``idle_ms`` (at least ``grace_ms``) its state goes. All state lives in the state store, so a stream that is
    stopped between turns goes on where it was.
    """

    def __init__(self, first: int = 1, grace_ms: int = 10_000, idle_ms: int = 3_600_000):
        self.first, self.grace_ms, self.idle_ms = first, grace_ms, max(grace_ms, idle_ms)

    def init(self, handle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", STATE + ", next long, idle_at long")
        self.waiting = handle.getMapState("waiting", "turn long", "user_input string, address_list array<string>")
        self.skipped = handle.getMapState("skipped", "turn long", "there boolean")

    def _held(self) -> tuple[dict, int | None, int]:
        if not self.carried.exists():
            return {}, self.first, 0
        *values, following, idle_at = self.carried.get()
        return ({} if values[0] is None else dict(zip(CARRIED, values))), following, idle_at

    def _take(self, key, held: dict, following: int, leap: bool) -> Iterator[Row]:
        """Take what waits as long as it goes on from ``following``; with ``leap`` the least turn that waits goes on from wherever it is."""
        waiting = {k[0]: v for k, v in self.waiting.iterator()}
        out = []
        while waiting:
            turn = min(waiting)
            if turn != following and not leap:
                break
            leap = False
            for missed in range(following, turn):
                self.skipped.updateValue((missed,), (True,))
            said, known = waiting.pop(turn)
            self.waiting.removeKey((turn,))
            outcome = step({"user_input": said, "address_list": known} | held)
            held, following = {k: outcome[k] for k in CARRIED}, turn + 1
            out.append(Row(call_id=key[0], turn=turn, user_input=said, **outcome, late=False))
        self.held, self.following = held, following
        yield from out

    def _keep(self, timers, due: int) -> None:
        """Write what is carried, and set the one timer: at ``due``."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        values = tuple(self.held[k] for k in CARRIED) if self.held else (None,) * len(CARRIED)
        now = timers.getCurrentProcessingTimeInMs()
        self.carried.update((*values, self.following, now + self.idle_ms))
        self.handle.registerTimer(now + due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, following, _ = self._held()
        for r in rows:
            if r.turn >= following:
                self.waiting.updateValue((r.turn,), (r.user_input, r.address_list))
            elif self.skipped.containsKey((r.turn,)) or r.turn < self.first:
                self.skipped.removeKey((r.turn,))
                yield Row(call_id=key[0], turn=r.turn, user_input=r.user_input, **dict.fromkeys(_OUTCOMES), late=True)
        yield from self._take(key, held, following, False)
        self._keep(timerValues, self.grace_ms if next(iter(self.waiting.iterator()), None) else self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, following, idle_at = self._held()
        if next(iter(self.waiting.iterator()), None):
            yield from self._take(key, held, following, True)
            more = next(iter(self.waiting.iterator()), None)
            self._keep(timerValues, self.grace_ms if more else self.idle_ms)
        else:
            for state in (self.carried, self.waiting, self.skipped):
                state.clear()

    def close(self) -> None:
        pass


_OUTCOMES = [x.split(":")[0].strip() for x in OUTCOME.removeprefix("struct<").removesuffix(">").split(",")]


def ordered_dialogue(turns: DataFrame, first: int = 1, grace_ms: int = 10_000, idle_ms: int = 3_600_000) -> DataFrame:
    """The outcome of each turn of a stream (call_id, turn, user_input, address_list) by :class:`Dialogue`, with ``late``.

    Needs the RocksDB state store (STATE_STORE); turns of a call number from ``first`` on.
    """
    rows = turns.selectExpr("CAST(call_id AS STRING) AS call_id", "CAST(turn AS LONG) AS turn", "user_input", "address_list")
    return rows.groupBy("call_id").transformWithState(Dialogue(first, grace_ms, idle_ms), StructType.fromDDL(ORDERED), "append", "ProcessingTime")


def call_store(calls: DataFrame) -> DataFrame:
    """(callId, content): the last content of each call by ``at``, for the update or complete mode."""
    from pyspark.sql import functions as F

    return calls.groupBy("callId").agg(F.max_by("content", "at").alias("content"))


def arriving_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A stream of the files below ``path`` (FILE), each once."""
    reader = spark.readStream.format("binaryFile").schema(FILE)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
