"""Exact deduplication by 128-bit content hash, with the bytes compared inside each hash group.

Plan: one aggregation keyed by (hash, normalised text). Spark's hash aggregate meets rows by hash and then compares
the key bytes, so texts that merely share a hash stay apart; map-side partial aggregation leaves one row per text and
task, whatever the number of copies. The group's result returns to the slim rows (no text) by a join on two digests.

Defined cases: null text equals the empty one; a null id sorts after every other id; of rows that share an id and a text but
for white space, those with the most code points are kept; rows that repeat id and length too are all marked as kept and
counted in group_size, and of them keep_distinct returns the one whose text has the least digest; very long texts are keys
like others; other columns are not read, whatever their names, and keep_distinct returns them. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of_keys, text_or_empty, without_spaces

_WIDE = "decimal(38,0)"
_TOP = "9223372036854775808"  # one above the largest id: where a null id sorts
_STEP = "36893488147419103232"  # more than all ids span


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, code points, 128-bit hash, SHA-256 and the text without white space."""
    bare = without_spaces(text_or_empty(text_col))
    return docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.length(text_or_empty(text_col)).cast("long").alias("_chars"),
        bare.alias("_bare"),
    ).withColumns({"_hash": F.unhex(F.md5("_bare")), "_sha": F.sha2("_bare", 256)})


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: (_hash, _sha, keep_id, group_size, chars)."""
    # code points first, then the smallest id, as one number: fixed-width buffers keep this a hash aggregate
    order = F.col("_chars").cast(_WIDE) * F.lit(_STEP).cast(_WIDE) - F.coalesce(
        F.col("_id").cast(_WIDE), F.lit(_TOP).cast(_WIDE)
    )
    best = F.max(order.cast(_WIDE))
    grouped = digests(docs, id_col, text_col).groupBy("_hash", "_bare").agg(
        best.alias("_best"), F.count(F.lit(1)).alias("group_size"), F.max("_chars").alias("_most")
    )
    kept = F.col("_most").cast(_WIDE) * F.lit(_STEP).cast(_WIDE) - F.col("_best")
    kept = kept.cast(_WIDE)
    return grouped.select(
        "_hash",
        F.sha2("_bare", 256).alias("_sha"),
        F.when(kept < F.lit(_TOP).cast(_WIDE), kept.cast("long")).alias("keep_id"),
        "group_size",
        F.col("_most").alias("chars"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, id_col, text_col).select("_id", "_hash", "_sha", "_chars")
    return rows.join(groups(docs, id_col, text_col), ["_hash", "_sha"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_chars") == F.col("chars"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, once each."""
    kept = groups(docs, id_col, text_col).select(F.col("keep_id").alias("id"), F.col("_sha").alias("sha"), "chars")
    text = text_or_empty(text_col)
    keys = {"id": F.col(id_col).cast("long"), "sha": F.sha2(without_spaces(text), 256), "chars": F.length(text).cast("long")}
    return rows_of_keys(docs, keys, kept, [F.sha2(text, 256)])
