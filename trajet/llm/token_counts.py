"""Exact length histogram: one count per encoded length answers totals, quantiles and truncated totals.

Workers send lengths only; the histogram has at most sqrt(2 * tokens) rows, since distinct lengths add up to no more than
all tokens. Suffix sums run in blocks of lengths: block totals first, then a window inside each block.

Defined cases: null and empty texts have length 0; repeated rows count each, and texts of equal length share a row; very
long texts are encoded whole and are one length; ids may be null or repeat, since no column but the text is read, whatever
the others' names; an empty table gives an empty histogram.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .tokens import TOKENIZER_FILE, encoder

BLOCK = 64


def encoded_length(text_col: str = "text", tokenizer: str = TOKENIZER_FILE):
    @F.pandas_udf("long")
    def length(texts: pd.Series) -> pd.Series:
        enc = encoder(tokenizer)
        return pd.Series(list(map(len, enc.encode_all(texts.tolist()))), dtype="int64")

    return length(text_or_empty(text_col))


def histogram(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """(tokens, docs)"""
    return docs.select(encoded_length(text_col, tokenizer).alias("tokens")).groupBy("tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """(tokens, docs) -> + docs_from, tokens_from (of documents at least as long), truncated_total (all documents cut at
    this length), share_to (of documents at most as long)."""
    # two readers follow; the texts are encoded once
    hist = cut(hist).withColumn("block", F.floor(F.col("tokens") / BLOCK)).withColumn("mass", F.col("tokens") * F.col("docs"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("mass").alias("m")).select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("m").over(after), F.lit(0)).alias("mass_after"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("m").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    docs_from = F.col("docs_after") + F.sum("docs").over(inside)
    tokens_from = F.col("mass_after") + F.sum("mass").over(inside)
    return hist.join(blocks, "block").select(
        "tokens",
        "docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + F.col("tokens") * docs_from).alias("truncated_total"),
        ((F.col("all_docs") - docs_from + F.col("docs")) / F.col("all_docs")).alias("share_to"),
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, total, docs_cut) for any limits, from the histogram alone."""
    pairs = hist.withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    return pairs.groupBy("context_limit").agg(
        F.sum(F.col("docs") * F.least("tokens", "context_limit")).alias("total"),
        F.sum(F.when(F.col("tokens") > F.col("context_limit"), F.col("docs")).otherwise(0)).alias("docs_cut"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, tokens): the least length that this share of the documents does not exceed."""
    wanted = F.array(*[F.lit(float(x)) for x in shares])
    reached = sums.withColumn("share", F.explode(F.filter(wanted, lambda x: x <= F.col("share_to"))))
    return reached.groupBy("share").agg(F.min("tokens").alias("tokens"))
