"""Messages between an SDK's shape and the core's, over arrays of part structs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a role may carry on the way out.
LEGAL = {"user": ("text", "image", "file"), "assistant": ("text", "tool_use", "file"), "tool": ("tool_result",), "system": ("text",)}


def to_core(df: DataFrame) -> DataFrame:
    """Reasoning becomes text, denied calls a marker, approvals go. content: array<struct<type, text, id, name>>"""

    def one(p):
        kind = F.when(p["type"] == "reasoning", "text").when(p["type"] == "tool-call", "tool_use").when(p["type"].isin("tool-result", "tool-denied"), "tool_result").otherwise(p["type"])
        text = F.when(p["type"] == "tool-denied", F.lit("[denied]")).otherwise(p["text"])
        return F.struct(kind.alias("type"), text.alias("text"), p["id"].alias("id"), p["name"].alias("name"))

    return df.withColumn("content", F.transform(F.filter("content", lambda p: p["type"] != "approval"), one))


def to_sdk(df: DataFrame) -> DataFrame:
    """System text is joined by line breaks; parts that a role may not carry go."""
    legal = F.create_map(*[x for r, kinds in LEGAL.items() for x in (F.lit(r), F.array(*map(F.lit, kinds)))])
    kept = F.filter("content", lambda p: F.array_contains(legal[F.col("role")], p["type"]))
    kind = lambda p: F.when(p["type"] == "tool_use", "tool-call").when(p["type"] == "tool_result", "tool-result").when(p["type"] == "image", "file").otherwise(p["type"])
    parts = F.transform(kept, lambda p: F.struct(kind(p).alias("type"), p["text"].alias("text"), p["id"].alias("id"), p["name"].alias("name")))
    joined = F.array(F.struct(F.lit("text").alias("type"), F.array_join(F.transform(kept, lambda p: p["text"]), "\n").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")))
    return df.withColumn("content", F.when(F.col("role") == "system", joined).otherwise(parts))
