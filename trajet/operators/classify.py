"""Session features, the rule classifier, hysteresis and the dispatch policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The classifier's thresholds.
RECENT_TURNS = 3
COLD_START_TURNS = 2
CONV_SCORE, CONV_TOOL_CEILING, TOOL_SCORE = 0.6, 0.3, 0.5
#: class -> (observer, offloader)
POLICY = {"conversational": (True, False), "tool_heavy": (False, True), "mixed": (True, True)}


def features(parts: DataFrame) -> DataFrame:
    """One row per message with role, part_type, bytes and turn_index -> one row per session.

    One shuffle: the newest turn comes from a window over the session, the rest are conditional aggregates.
    """
    last = F.max("turn_index").over(Window.partitionBy("session_id"))
    is_use, is_result = F.col("part_type") == "tool_use", F.col("part_type") == "tool_result"
    recent = is_use & (F.coalesce("turn_index", F.lit(0)) > F.col("_last") - RECENT_TURNS)
    turns = F.coalesce(F.max("_last") + 1, F.lit(0))
    return (
        parts.withColumn("_last", last)
        .groupBy("session_id")
        .agg(
            turns.cast("long").alias("turns_total"),
            F.when(turns > 0, F.count_if(is_use) / turns).otherwise(0.0).alias("tool_call_density"),
            F.coalesce(F.avg(F.when(is_result, F.col("bytes"))), F.lit(0.0)).alias("avg_tool_result_size"),
            (F.count_if(recent) / RECENT_TURNS).alias("recent_tool_density"),
            (F.count_if(F.col("role") == "user") / F.count(F.lit(1))).alias("user_turn_ratio"),
            F.coalesce(F.bool_or(F.col("part_type").isin("image", "file")), F.lit(False)).alias("multimodal_flag"),
            F.ceil(F.sum("bytes") / 4).cast("long").alias("cumulative_tokens"),
        )
    )


def raw_class(turns, density, recent, ratio):
    conv = (1 - density) * ratio
    tool = density * 0.5 + recent * 0.5
    return (
        F.when(turns < COLD_START_TURNS, "mixed")
        .when((conv > CONV_SCORE) & (tool < CONV_TOOL_CEILING), "conversational")
        .when(tool > TOOL_SCORE, "tool_heavy")
        .otherwise("mixed")
    )


def classify(feats: DataFrame) -> DataFrame:
    return feats.withColumn("class", raw_class(F.col("turns_total"), F.col("tool_call_density"), F.col("recent_tool_density"), F.col("user_turn_ratio")))


def prefix_classes(parts: DataFrame) -> DataFrame:
    """The class that each prefix ending with a turn gets: (session_id, turn_index, raw_class). Running sums only."""
    upto = Window.partitionBy("session_id").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, 0)
    last_of_turn = Window.partitionBy("session_id", "turn_index").orderBy(F.col("msg_idx").desc())
    by_turn = Window.partitionBy("session_id").orderBy("turn_index").rangeBetween(-(RECENT_TURNS - 1), 0)
    uses = F.sum(F.when(F.col("part_type") == "tool_use", 1).otherwise(0))
    ends = (
        parts.withColumn("_uses", uses.over(upto))
        .withColumn("_users", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(upto))
        .withColumn("_n", F.count(F.lit(1)).over(upto))
        .withColumn("_recent", uses.over(by_turn))
        .withColumn("_rn", F.row_number().over(last_of_turn))
        .filter("_rn = 1 and turn_index is not null")
    )
    turns = F.col("turn_index") + 1
    cls = raw_class(turns, F.col("_uses") / turns, F.col("_recent") / RECENT_TURNS, F.col("_users") / F.col("_n"))
    return ends.select("session_id", "turn_index", cls.alias("raw_class"))


def hysteresis(classes: DataFrame) -> DataFrame:
    """The class changes only after two equal dissents in a row, so it is the raw class of the latest turn that repeats its
    predecessor's, or the first one: two windows over a session's turns."""
    order = Window.partitionBy("session_id").orderBy("turn_index")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    repeated = F.when(F.col("raw_class") == F.lag("raw_class").over(order), F.col("raw_class"))
    marked = classes.select("session_id", "turn_index", "raw_class", repeated.alias("_repeated"))
    cls = F.coalesce(F.last("_repeated", ignorenulls=True).over(upto), F.first("raw_class").over(upto))
    return marked.select("session_id", "turn_index", "raw_class", cls.alias("class"))


def dispatch(classes: DataFrame, classifier: bool = True, configured: str | None = None, observer: bool = True, offloader: bool = True) -> DataFrame:
    """+ run_observer, run_offloader. Flags branch while the plan is built; the policy is a three-way expression."""
    if not classifier and configured is None:
        raise ValueError("without the classifier a configured class is needed")
    cls = F.col("class") if classifier else F.lit(configured)
    wants = lambda k: cls.isin([c for c, p in POLICY.items() if p[k]])
    return classes.withColumns({"class": cls, "run_observer": wants(0) & F.lit(observer), "run_offloader": wants(1) & F.lit(offloader)})
