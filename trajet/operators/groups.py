"""Pairing of tool calls with their results, and what hangs on the pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import group_id, pointer_stub

# Offload thresholds in bytes.
T_SIZE, T_SIZE_MIXED, T_CUM = 4096, 2048, 24_000
KEEP_LAST_GROUPS = 2


def pairs(parts: DataFrame) -> DataFrame:
    """Full outer join of calls and results on (session, id): group, inflight or orphan. The last call of an id wins."""
    latest = Window.partitionBy("session_id", "use_id").orderBy(F.col("msg_idx").desc())
    uses = (
        parts.filter("part_type = 'tool_use'")
        .withColumn("_rn", F.row_number().over(latest))
        .filter("_rn = 1")
        .select("session_id", "use_id", F.col("msg_idx").alias("use_idx"), F.coalesce("turn_index", F.lit(0)).alias("turn_index"), "tool_name")
    )
    results = parts.filter("part_type = 'tool_result'").select(
        "session_id", "use_id", F.col("msg_idx").alias("result_idx"), F.col("bytes").alias("result_bytes"), "payload_len"
    )
    kind = F.when(F.col("use_idx").isNull(), "orphan").when(F.col("result_idx").isNull(), "inflight").otherwise("group")
    return (
        uses.join(results, ["session_id", "use_id"], "full")
        .withColumn("kind", kind)
        .withColumn("group_id", F.when(F.col("kind") != "orphan", group_id(F.col("use_id"), F.col("turn_index"))))
    )


def reasoning(parts: DataFrame) -> DataFrame:
    """The message before a call explains it when it is an assistant's text: an offset of one, no join."""
    order = Window.partitionBy("session_id").orderBy("msg_idx")
    is_text = (F.lag("role").over(order) == "assistant") & (F.lag("part_type").over(order) == "text")
    before = F.when(is_text, F.lag("msg_idx").over(order))
    return parts.withColumn("reasoning_idx", before).filter("part_type = 'tool_use'").select("session_id", "use_id", F.col("msg_idx").alias("use_idx"), "reasoning_idx")


def offload(groups: DataFrame, t_size=T_SIZE, t_cum: int = T_CUM, keep_last: int = KEEP_LAST_GROUPS) -> DataFrame:
    """Decides each group in result order: the last ones stay; larger than t_size goes; what would lift the kept total
    over t_cum goes. The kept total depends on earlier decisions, so workers stream each session's groups in order and
    carry one number; no session is held."""
    t_size = t_size if not isinstance(t_size, int) else F.lit(t_size)
    names = ["result_idx", "group_id", "use_id", "tool_name", "result_bytes", "turn_index"]
    newest = Window.partitionBy("session_id").orderBy(F.col("result_idx").desc(), F.col("group_id").desc(), F.col("use_id").desc())
    ranked = groups.select("session_id", *names, t_size.cast("long").alias("t_size"), (F.row_number().over(newest) - 1).alias("after"))
    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["session_id", *names]) + ", offloaded boolean, kept_before long"

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, kept = None, 0
        for batch in batches:
            goes, before = [], []
            for of, size, most, after in zip(batch["session_id"], batch["result_bytes"], batch["t_size"], batch["after"]):
                if of != session:
                    session, kept = of, 0
                goes.append(after >= keep_last and (size > most or kept + size > t_cum))
                before.append(kept)
                kept += 0 if goes[-1] else size
            yield batch[["session_id", *names]].assign(offloaded=goes, kept_before=before)

    ordered = ranked.repartition("session_id").sortWithinPartitions("session_id", F.col("after").desc())
    return ordered.mapInPandas(decide, schema)


def pointers(decided: DataFrame) -> DataFrame:
    return decided.filter("offloaded").select(
        "session_id", F.col("group_id").alias("recall_id"), "tool_name", F.col("result_bytes").alias("original_size_bytes"), "turn_index",
        pointer_stub(F.col("group_id"), F.col("tool_name"), F.col("result_bytes")).alias("stub"),
    )


def recall(requests: DataFrame, known: DataFrame) -> DataFrame:
    """(session_id, recall_id) requests against pointers; a miss says so."""
    found = known.select("session_id", "recall_id", F.col("original_size_bytes"), F.lit(True).alias("_hit"))
    answer = F.when(F.col("_hit"), F.format_string("summary of %d bytes", F.col("original_size_bytes"))).otherwise(F.concat(F.lit("unknown recall_id: "), F.col("recall_id")))
    return requests.join(found, ["session_id", "recall_id"], "left").select("session_id", "recall_id", F.coalesce("_hit", F.lit(False)).alias("hit"), answer.alias("answer"))
