"""Replay of recorded tool outputs: an exact match, then a subset match, then the next unused slot by call number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def is_subset(small, large):
    """Whether every field of one JSON object has an equal value in the other. Nested values are equal whatever the
    order of their objects' keys: as variants they write themselves with sorted keys. Null, arrays and bare values are no objects."""
    kind = "map<string,variant>"
    a, b = F.from_json(small, kind), F.from_json(large, kind)
    same = lambda e: F.map_contains_key(b, e["key"]) & F.to_json(F.struct(e["value"].alias("v"))).eqNullSafe(F.to_json(F.struct(F.try_element_at(b, e["key"]).alias("v"))))
    return F.coalesce(F.startswith(F.ltrim(large), F.lit("{")) & F.forall(F.map_entries(a), same), F.lit(False))


def replay(calls: DataFrame, fixtures: DataFrame) -> DataFrame:
    """calls (session_id, seq, tool_name, args), fixtures (tool_name, kind, args, slot, output) -> matched_by, output.

    Kind `exact` compares arguments as they stand; `subset` asks that its fields occur in the call's; `first` slots go out
    in order to the calls that none of these answers. A tool has few subset fixtures, so they ride along as one array.
    """
    exact = fixtures.filter("kind = 'exact'").groupBy("tool_name", "args").agg(F.min_by("output", "slot").alias("exact_output"))
    parts = fixtures.filter("kind = 'subset'").groupBy("tool_name").agg(F.array_sort(F.collect_list(F.struct("slot", "args", "output"))).alias("parts"))
    joined = calls.join(exact, ["tool_name", "args"], "left").join(parts, "tool_name", "left")
    fits = F.filter("parts", lambda p: is_subset(p["args"], F.col("args")))
    marked = joined.withColumn("subset_output", F.get(fits, F.lit(0))["output"])
    open_ = F.col("exact_output").isNull() & F.col("subset_output").isNull()
    order = Window.partitionBy("session_id", "tool_name", open_).orderBy("seq")
    marked = marked.withColumn("slot", F.when(open_, F.row_number().over(order) - 1))
    numbered = F.row_number().over(Window.partitionBy("tool_name").orderBy("slot")) - 1
    slots = fixtures.filter("kind = 'first'").withColumn("slot", numbered).select("tool_name", "slot", F.col("output").alias("slot_output"))
    found = marked.join(slots, ["tool_name", "slot"], "left")
    by = (
        F.when(F.col("exact_output").isNotNull(), "exact")
        .when(F.col("subset_output").isNotNull(), "subset")
        .when(F.col("slot_output").isNotNull(), "first")
        .otherwise("none")
    )
    return found.select("session_id", "seq", "tool_name", by.alias("matched_by"), F.coalesce("exact_output", "subset_output", "slot_output").alias("output"))
