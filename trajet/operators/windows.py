"""Tail windows under a token budget. Four rules, one ordering: newest first within a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest():
    return Window.partitionBy("session_id").orderBy(F.col("msg_idx").desc())


def before():
    return newest().rowsBetween(Window.unboundedPreceding, -1)


def upto():
    return newest().rowsBetween(Window.unboundedPreceding, 0)


def session():
    return Window.partitionBy("session_id")


def tail_budget(df: DataFrame, budget: int) -> DataFrame:
    """Walks back while the tokens taken are below the budget, so the last one taken may overshoot."""
    return df.withColumn("_t", F.coalesce(F.sum("tokens").over(before()), F.lit(0))).filter(F.col("_t") < budget).drop("_t")


def tail_clip(df: DataFrame, target: int) -> DataFrame:
    """Takes while the tokens stay within the target; the newest message always stays."""
    marked = df.withColumns({"_t": F.sum("tokens").over(upto()), "_rn": F.row_number().over(newest())})
    return marked.filter((F.col("_t") <= target) | (F.col("_rn") == 1)).drop("_t", "_rn")


def naive_truncation(df: DataFrame, budget: int) -> DataFrame:
    """System messages stay and their tokens are set aside; the newest others stay while they fit; a marker counts what went."""
    is_system = F.col("role") == "system"
    reserved = F.sum(F.when(is_system, F.col("tokens")).otherwise(0)).over(session())
    running = F.sum(F.when(is_system, 0).otherwise(F.col("tokens"))).over(upto())
    marked = df.withColumn("_stays", is_system | (running <= F.greatest(F.lit(0), budget - reserved)))
    kept = marked.filter("_stays").select("session_id", "msg_idx", "role", "text", "tokens")
    gone = marked.filter("not _stays").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    text = F.format_string("<<<earlier history truncated: %d turns dropped>>>", F.col("n"))
    marker = gone.select("session_id", F.lit(-1).cast("long").alias("msg_idx"), F.lit("user").alias("role"), text.alias("text"))
    return kept.unionByName(marker.withColumn("tokens", F.ceil(F.length("text") / 4).cast("long")))


def pair_start(seed: DataFrame, groups: DataFrame) -> DataFrame:
    """(session_id, start) -> the earliest start such that no group has its result inside and its call outside.

    By descending result, the groups that pull the start back are the first ones: each has its result at or behind the
    earliest call of those before it, or the start itself. One sort and two running values reach the fixpoint.
    """
    known = seed.select("session_id", F.col("start").cast("long").alias("start"))
    order = Window.partitionBy("session_id").orderBy(F.col("result_idx").desc(), "use_idx")
    earlier, upto_here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    pulled = F.least("start", F.min("use_idx").over(earlier))
    inside = groups.select("session_id", "use_idx", "result_idx").join(known, "session_id").withColumn("_fits", F.col("result_idx") >= pulled)
    chained = inside.withColumn("_fits", F.bool_and("_fits").over(upto_here)).filter("_fits")
    reached = chained.groupBy("session_id").agg(F.min("use_idx").alias("_least"))
    return known.join(reached, "session_id", "left").select("session_id", F.least("start", "_least").cast("long").alias("start"))


def watermark(df: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows after their session's last observed turn; rows without a turn stay."""
    last = F.coalesce("last_observed_turn", F.lit(-1))
    return df.join(observed, "session_id", "left").filter(F.col("turn_index").isNull() | (F.col("turn_index") > last)).drop("last_observed_turn")
