"""Accounting for compaction that a provider does itself: its blocks arrive in replies, and the newest one stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standing_block(replies: DataFrame) -> DataFrame:
    """(session_id, turn_index, block) -> + standing: the newest block up to each turn, echoed as the next prefix."""
    upto = Window.partitionBy("session_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    return replies.withColumn("standing", F.last("block", ignorenulls=True).over(upto))


def compaction_events(replies: DataFrame) -> DataFrame:
    """A turn with a block is an event: bytes of what was sent before, bytes of the block after."""
    return replies.filter("block is not null").select("session_id", "turn_index", F.octet_length("sent").cast("long").alias("before_bytes"), F.octet_length("block").cast("long").alias("after_bytes"))


def until_stop(turns: DataFrame, marker: str = "##STOP##", most: int = 20) -> DataFrame:
    """An episode's turns up to and with the first that holds the marker, at most `most`."""
    before = Window.partitionBy("session_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.bool_or(F.contains("text", F.lit(marker))).over(before), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index"))
    return turns.withColumns({"_stopped": stopped, "_rn": rank}).filter(~F.col("_stopped") & (F.col("_rn") <= most)).drop("_stopped", "_rn")


def session_report(events: DataFrame, bytes_per_token: int = 4) -> DataFrame:
    """(session_id, seq, kind, type, class, before_bytes, after_bytes) -> one row per session: last class, counts, tokens saved."""
    saved = F.greatest(F.lit(0), F.col("before_bytes") - F.col("after_bytes"))
    of = lambda t: F.count_if((F.col("kind") == "compaction") & (F.col("type") == t))
    return events.groupBy("session_id").agg(
        F.max_by("class", F.when(F.col("class").isNotNull(), F.col("seq"))).alias("last_class"),
        of("observer").alias("observations"),
        of("offload").alias("offloads"),
        F.count_if(F.col("kind") == "recall").alias("recalls"),
        F.round(F.coalesce(F.sum(F.when(F.col("type") == "offload", saved)), F.lit(0)) / bytes_per_token).cast("long").alias("tokens_offloaded"),
    )
