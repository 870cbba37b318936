"""A session's scratchpad and its observations as state with contents, on arbitrary stateful processing.

The scratchpad is a map of group ids to what was put there; a session that stays idle for longer than its time to live is
emptied, by the times of its rows, and an event-time timer removes what nobody comes back for. Observations are a list that
only grows; they live as long as the stream, since a session may come back at any time.

The batch forms answer the same over a table: windows per session, and per stretch of it without such a pause.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .state import IDLE_MS

PAD_ANSWER = "session_id long, seq long, kind string, group_id string, answer string, content string, entries long"
OBSERVED = "session_id long, seq long, observations array<string>, last_observed_turn long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keeping_maps(spark: SparkSession) -> None:
    """Maps, lists and timers need the RocksDB state store."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _millis(ts) -> int:
    return round(ts.timestamp() * 1000)


class Scratchpad(StatefulProcessor):
    """put: the content under the group id, replacing what is there. recall: what is there, or that nothing is. Either is
    an access."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "group_id string", "content string")
        self.facts = handle.getValueState("facts", "last long, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, n = self.facts.get() if self.facts.exists() else (None, 0)
        for row in sorted(rows, key=lambda r: r["seq"]):
            now = _millis(row["ts"])
            if last is not None and now - last > self.idle_ms:
                self.entries.clear()
                n = 0
            last, group = now, (row["group_id"],)
            known = self.entries.containsKey(group)
            if row["kind"] == "put":
                self.entries.updateValue(group, (row["content"],))
                n += not known
                answer, content = "kept", None
            else:
                answer, content = ("found", self.entries.getValue(group)[0]) if known else ("unknown", None)
            yield Row(session_id=key[0], seq=row["seq"], kind=row["kind"], group_id=row["group_id"], answer=answer, content=content, entries=n)
        self.facts.update((last, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # a timer that was not replaced: no row since
        self.entries.clear()
        self.facts.clear()
        return iter(())

    def close(self) -> None:
        pass


def scratchpad_contents(accesses: DataFrame, idle_ms: int = IDLE_MS, late: str = "1 minute") -> DataFrame:
    """(session_id, seq, ts, kind put or recall, group_id, content) stream -> an answer for each access, in the order of
    seq within a session; rows of a session come in that order from batch to batch. A row behind the watermark by `late`
    is dropped."""
    _keeping_maps(accesses.sparkSession)
    timed = accesses.withWatermark("ts", late)
    return timed.groupBy("session_id").transformWithState(Scratchpad(idle_ms), PAD_ANSWER, "append", "EventTime")


def scratchpad_answers(accesses: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Batch form of scratchpad_contents."""
    w = Window.partitionBy("session_id").orderBy("seq")
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    stretch = F.sum((t - F.lag(t).over(w) > idle_ms).cast("int")).over(w)
    df = accesses.withColumn("_stretch", F.coalesce(stretch, F.lit(0)))
    puts = F.col("kind") == "put"
    of_group = Window.partitionBy("session_id", "_stretch", "group_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(puts, F.struct("content")), ignorenulls=True).over(of_group)
    df = df.withColumn("_held", held)
    so_far = Window.partitionBy("session_id", "_stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    entries = F.sum((puts & F.col("_held").isNull()).cast("long")).over(so_far)
    answer = F.when(puts, "kept").when(F.col("_held").isNotNull(), "found").otherwise("unknown")
    return df.select(F.col("session_id").cast("long").alias("session_id"), F.col("seq").cast("long").alias("seq"), "kind", "group_id", answer.alias("answer"), F.when(~puts, F.col("_held.content")).alias("content"), entries.alias("entries"))


class Observations(StatefulProcessor):
    """The statements of a session in order, and the last turn they were observed at."""

    def init(self, handle) -> None:
        self.statements = handle.getListState("statements", "statement string")
        self.turn = handle.getValueState("turn", "last long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: r["seq"])
        fresh = [(r["statement"],) for r in rows if r["statement"] is not None]
        if fresh:
            self.statements.appendList(fresh)
        last = max([self.turn.get()[0] if self.turn.exists() else -1, *(r["turn_index"] for r in rows if r["turn_index"] is not None)])
        self.turn.update((last,))
        yield Row(session_id=key[0], seq=rows[-1]["seq"], observations=[s[0] for s in self.statements.get()], last_observed_turn=last)

    def close(self) -> None:
        pass


def observation_contents(events: DataFrame) -> DataFrame:
    """(session_id, seq, turn_index, statement) stream -> after each batch, every session of it with all its statements so
    far and its last observed turn (-1 for none). A null statement observes nothing."""
    _keeping_maps(events.sparkSession)
    return events.groupBy("session_id").transformWithState(Observations(), OBSERVED, "update", "None")


def observations_so_far(events: DataFrame) -> DataFrame:
    """Batch form: every row's session as it stands after it."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    said = F.collect_list("statement").over(w)
    last = F.coalesce(F.greatest(F.max("turn_index").over(w), F.lit(-1)), F.lit(-1))
    return events.select(F.col("session_id").cast("long").alias("session_id"), F.col("seq").cast("long").alias("seq"), said.alias("observations"), last.cast("long").alias("last_observed_turn"))
