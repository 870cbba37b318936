"""Span trees: sessions, their traces, and the spans inside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hierarchy(spans: DataFrame) -> DataFrame:
    """(session_id, trace_id, parent_id, name, type) with one row of type TRACE per trace -> counts per session."""
    is_trace = F.col("type") == "TRACE"
    return spans.groupBy("session_id").agg(
        F.count_if(is_trace).alias("traces"),
        F.count_if(is_trace & F.col("parent_id").isNull()).alias("root_traces"),
        F.count_if(is_trace & F.col("parent_id").isNotNull()).alias("nested_traces"),
        F.count_if(F.col("name") == "eval.turn").alias("turn_spans"),
        F.count_if(F.col("type") == "TOOL").alias("tool_spans"),
    )


def match_sessions(sessions: DataFrame, wanted: str, prefix: bool = False) -> DataFrame:
    same = F.startswith("session_id", F.lit(wanted)) if prefix else F.col("session_id") == wanted
    return sessions.filter(same)


def spans_of(records: DataFrame) -> DataFrame:
    """Run records as spans: a trace per task, a span per turn."""
    session = F.concat_ws("/", "bench", "config_id", F.col("seed").cast("string"))
    task = F.col("task_id").cast("string")
    trace = records.select(session.alias("session_id"), task.alias("trace_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("eval.task").alias("name"), F.lit("TRACE").alias("type"))
    turns = records.select(session.alias("session_id"), task.alias("trace_id"), task.alias("parent_id"), F.explode("turns").alias("t"))
    return trace.unionByName(turns.select("session_id", "trace_id", "parent_id", F.lit("eval.turn").alias("name"), F.lit("SPAN").alias("type")))


def instrumentation(events: DataFrame) -> DataFrame:
    """Core events under their instrumentation names: a classifier signal is a class signal, the rest keep theirs.

    Payload fields that an event lacks are left out of its JSON.
    """
    kind = F.when(F.col("kind") == "classifier_signal", "class_signal").otherwise(F.col("kind"))
    fields = {
        "compaction": ["type", "turn_index", "before_bytes", "after_bytes", "llm_cost_usd"],
        "recall": ["recall_id", "tool_name", "reason", "turn_index"],
        "classifier_signal": ["turn_index", "class", "confidence"],
    }
    payload = F.lit(None).cast("string")
    for k, names in fields.items():
        payload = F.when(F.col("kind") == k, F.to_json(F.struct(*names))).otherwise(payload)
    return events.select("session_id", "seq", kind.alias("kind"), payload.alias("payload"))
