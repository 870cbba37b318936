"""Observation and reflection through a pluggable caller: a function from a prompt column to a reply column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .observations import parse
from .strategies import flatten
from .windows import tail_clip

Caller = Callable[[Column], Column]
#: What an observer leaves of the window, as a share of its threshold.
RESIDUE = 0.2


def stub_caller(prompt: Column) -> Column:
    """Deterministic replies: one observation on the prompt's length, so plans run without a network."""
    return F.format_string("- 2024-01-01 (low) transcript of %d characters", F.length(prompt))


def observe(messages: DataFrame, threshold: int, caller: Caller | None = None, parity: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report per session, observations, what stays of the messages).

    Nothing runs below the threshold or without a caller. An observer that finds nothing leaves the window alone, so no
    content is lost; parity=True clips it nevertheless.
    """
    totals = messages.groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.max("msg_idx").alias("source_turn"))
    reason = F.when(F.col("tokens") < threshold, "below_threshold")
    if caller is None:
        report = totals.select("session_id", "tokens", F.lit(False).alias("ran"), F.coalesce(reason, F.lit("no_llm_caller")).alias("reason"))
        return report, parse(totals.select("session_id", "source_turn", F.lit("").alias("text"))).limit(0), messages
    due = totals.filter(F.col("tokens") >= threshold)
    replies = flatten(messages).join(due, "session_id").select("session_id", "source_turn", caller(F.col("transcript")).alias("text"))
    parsed = parse(replies)
    failed = parsed.filter("reason is not null").select("session_id").distinct().withColumn("_bad", F.lit(True))
    good = parsed.join(failed, "session_id", "left_anti")
    counts = good.groupBy("session_id").agg(F.count(F.lit(1)).alias("extracted"))
    report = (
        totals.join(failed, "session_id", "left")
        .join(counts, "session_id", "left")
        .select(
            "session_id", "tokens",
            (reason.isNull() & F.col("_bad").isNull()).alias("ran"),
            F.coalesce(reason, F.when(F.col("_bad"), "parse_error")).alias("reason"),
            F.coalesce("extracted", F.lit(0)).cast("long").alias("extracted"),
        )
    )
    clips = report.filter("ran" if parity else "ran and extracted > 0").select("session_id")
    clipped = tail_clip(messages.join(clips, "session_id", "left_semi"), int(RESIDUE * threshold))
    return report, good, messages.join(clips, "session_id", "left_anti").unionByName(clipped)


def reflect(observations: DataFrame, threshold: int, caller: Caller | None = None) -> DataFrame:
    """Sessions whose observations reach the threshold get them replaced by the caller's, dated by the earliest turn."""
    if caller is None:
        return observations
    line = F.format_string("- %d (%s) %s", "timestamp", "confidence", "statement")
    tokens = F.ceil(F.length("statement") / 4)
    per = observations.groupBy("session_id").agg(F.sum(tokens).alias("tokens"), F.min("source_turn").alias("source_turn"), F.array_sort(F.collect_list(F.struct("timestamp", "seq", line.alias("line")))).alias("l"))
    due = per.filter(F.col("tokens") >= threshold)
    fresh = parse(due.select("session_id", "source_turn", caller(F.array_join(F.col("l")["line"], "\n")).alias("text"))).filter("reason is null")
    return observations.join(due.select("session_id"), "session_id", "left_anti").unionByName(fresh)


def task_aware(messages: DataFrame, query: Column, caller: Caller = stub_caller) -> DataFrame:
    """One row per session: the caller's digest of the transcript in view of the query."""
    prompt = F.concat(F.lit("Live query: "), query, F.lit("\nHistory:\n"), "transcript")
    text = caller(prompt)
    return flatten(messages).select("session_id", text.alias("text"), F.ceil(F.length(text) / 4).cast("long").alias("tokens"))


def clip_window(messages: DataFrame, groups: DataFrame, inflight: DataFrame, target: int) -> DataFrame:
    """tail_clip whose start moves back to the calls of kept results and to every open call, in one pass."""
    start = tail_clip(messages, target).groupBy("session_id").agg(F.min("msg_idx").alias("start"))
    back = groups.join(start, "session_id").filter("result_idx >= start").groupBy("session_id").agg(F.min("use_idx").alias("a"))
    open_ = inflight.groupBy("session_id").agg(F.min("use_idx").alias("b"))
    moved = start.join(back, "session_id", "left").join(open_, "session_id", "left").select("session_id", F.least("start", "a", "b").alias("start"))
    return messages.join(moved, "session_id").filter("msg_idx >= start").drop("start")
