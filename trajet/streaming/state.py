"""Keyed state on streams: the batch operators' folds, one session at a time, on Structured Streaming's state store.

Each state has a timer, set anew by every row of its session; when it runs out, the state is removed. The scratchpad's
is its idle time; the others last for KEPT_MS without a row, and a session that comes back later starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_MS = 3_600_000
#: How long a silent session's state is held.
KEPT_MS = 86_400_000
# Window and number of calls that a session may make.
RATE_WINDOW_S, RATE_LIMIT = 300, 30


def hysteresis_stream(classes: DataFrame, kept_ms: int = KEPT_MS) -> DataFrame:
    """(session_id, turn_index, raw_class) stream -> + class. State: last class, pending class, its count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, pending, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values("turn_index")
        out = []
        for raw in rows["raw_class"]:
            n = n + 1 if raw == pending else 1
            if last is None or raw == last or (raw == pending and n >= 2):
                last, pending, n = raw, None, 0
            else:
                pending = raw
            out.append(last)
        state.update((last, pending, n))
        state.setTimeoutDuration(kept_ms)
        yield rows.assign(session_id=key[0], **{"class": out})[["session_id", "turn_index", "raw_class", "class"]]

    return classes.groupBy("session_id").applyInPandasWithState(
        step, "session_id long, turn_index long, raw_class string, class string", "last string, pending string, n int", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def scratchpad_stream(puts: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """(session_id, ts, size) stream -> entries and bytes held per session. A session without access for longer than
    idle_ms is emptied: by the times of its rows, or by the timer, which says so in a row and forgets the session."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "entries": [0], "bytes": [0], "evictions": [1]})
            return
        held, size, last = state.get if state.exists else (0, 0, None)
        rows = pd.concat(list(batches)).sort_values("ts")
        evicted = 0
        for ts, n in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["size"]):
            if last is not None and ts - last > idle_ms * 1000:
                evicted, held, size = evicted + 1, 0, 0
            held, size, last = held + 1, size + int(n), int(ts)
        state.update((held, size, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": [key[0]], "entries": [held], "bytes": [size], "evictions": [evicted]})

    return puts.groupBy("session_id").applyInPandasWithState(
        step, "session_id long, entries long, bytes long, evictions long", "held long, size long, last long", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def limit_calls(times: list[float], window: float = RATE_WINDOW_S, most: int = RATE_LIMIT, kept: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Which calls pass, and the passed ones still inside the window. Refused calls are not counted."""
    kept, out = list(kept or []), []
    for t in times:
        kept = [x for x in kept if x > t - window]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out, kept


def rate_limited(df: DataFrame, window: float = RATE_WINDOW_S, most: int = RATE_LIMIT) -> DataFrame:
    """Batch form: (session_id, event_id, ts) -> allowed. A refusal depends on all before it, so a session is one fold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"])
        return pdf.assign(allowed=limit_calls(pdf["t"].tolist(), window, most)[0])[["session_id", "event_id", "allowed"]]

    calls = df.select("session_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return calls.groupBy("session_id").applyInPandas(run, "session_id long, event_id long, allowed boolean")


def rate_limit_stream(calls: DataFrame, window: float = RATE_WINDOW_S, most: int = RATE_LIMIT, kept_ms: int = KEPT_MS) -> DataFrame:
    """(session_id, event_id, t) stream -> allowed; the state holds at most `most` times."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        allowed, kept = limit_calls(rows["t"].tolist(), window, most, list(state.get[0]) if state.exists else [])
        state.update((kept,))
        state.setTimeoutDuration(kept_ms)
        yield rows.assign(session_id=key[0], allowed=allowed)[["session_id", "event_id", "allowed"]]

    return calls.groupBy("session_id").applyInPandasWithState(step, "session_id long, event_id long, allowed boolean", "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def idle_sessions(stream: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: event-time sessions by the idle constant, with a watermark for late rows."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))


def prepared_stream(events: DataFrame, kept_ms: int = KEPT_MS) -> DataFrame:
    """(session_id, seq, kind, hash) stream -> answer. One preparation is held per session.

    `prepare` keeps the hash unless one is held already; `consume` answers whether the held hash equals the asked one and
    forgets it either way; `invalidate` forgets it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for kind, asked in zip(rows["kind"], rows["hash"]):
            if kind == "prepare":
                out.append("kept" if held is None else "busy")
                held = held or asked
            elif kind == "consume":
                out.append("miss" if held is None else "hit" if held == asked else "stale")
                held = None
            else:
                out.append("cleared")
                held = None
        state.update((held,))
        state.setTimeoutDuration(kept_ms)
        yield rows.assign(session_id=key[0], answer=out)[["session_id", "seq", "answer"]]

    return events.groupBy("session_id").applyInPandasWithState(step, "session_id long, seq long, answer string", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tier2_stream(events: DataFrame, kept_ms: int = KEPT_MS) -> DataFrame:
    """(session_id, seq, turn_index, statement) stream -> observations held and the last observed turn, per session."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches))
        n, last = n + int(rows["statement"].notna().sum()), max(last, int(rows["turn_index"].max()))
        state.update((n, last))
        state.setTimeoutDuration(kept_ms)
        yield pd.DataFrame({"session_id": [key[0]], "observations": [n], "last_observed_turn": [last]})

    return events.groupBy("session_id").applyInPandasWithState(
        step, "session_id long, observations long, last_observed_turn long", "n long, last long", "update", GroupStateTimeout.ProcessingTimeTimeout
    )
