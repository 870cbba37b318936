"""Shards of near-equal bytes by sampled splitters.

Records stand in the order of a text hash, so equal texts are neighbours. A size-weighted sample of the distinct keys
gives quantile boundaries, which cut the order into ranges. Overfull ranges are subdivided: at equal steps of the key,
as often as their rows need, and a text that alone is too large for a range by a hash of its rows (of one row's repeats, by
their place in the input). Exact byte totals give each piece its place in the whole (those of the ranges, a bounded
number, on the driver; those of subdivisions by a window in each range), a window inside a piece places each text, and the
place of a text's middle decides its shard: shards differ by little more than the largest undivided text. Only slim
rows are shuffled, never texts.

Law: bytes. Equal texts share a shard unless they are a text that was subdivided and a boundary falls inside it.

Defined cases: null text counts 16 bytes and equals the empty text; rows that repeat are records of their own, and which
of them stands where is not told apart; slots of a shard go by key, id (null first) and text; other columns are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

SHARDS = 40
ROW_OVERHEAD = 16
#: A text over a PARTS-th of a shard, by bytes or rows, is subdivided.
PARTS = 32
#: Ranges from the sample: about one for RANGE_ROWS rows, MOST_RANGES at most; their totals come to the driver. One with
#: over OVERFULL rows is subdivided.
RANGE_ROWS, MOST_RANGES, OVERFULL = 500, 4_096, 10_000
#: Tables with a row for each piece are broadcast up to so many.
MOST_BROADCAST = 100_000
SAMPLES_PER_RANGE = 16


def splitters(keys: np.ndarray, weights: np.ndarray, ranges: int) -> np.ndarray:
    """Upper boundaries that cut the weighted sample into ranges of equal weight."""
    order = np.argsort(keys, kind="stable")
    keys, total = keys[order], np.cumsum(weights[order])
    if not len(keys):
        return np.array([], np.int64)
    at = np.searchsorted(total, np.arange(1, ranges) / ranges * total[-1])
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def _few(df: DataFrame) -> DataFrame:
    """Written out, and broadcast if it is small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = 5) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.shiftright(F.xxhash64(text), 1).alias("key"),
            F.xxhash64(F.col(id_col), text).alias("own"),
            F.monotonically_increasing_id().alias("nth"),
        )
    )
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n, total = max(n, 1), max(total, 1)
    sums = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")]
    texts = rows.groupBy("key").agg(*sums)

    # texts above a PARTS-th of a shard, and among them repeats of one row above it: fewer than 2 * shards * PARTS each
    parts = F.ceil(F.greatest(F.col("bytes") / total, F.col("rows") / n) * (shards * PARTS)).cast("int")
    large = texts.select("key", parts.alias("parts")).filter("parts > 1")
    large = spark.createDataFrame(large.toPandas().astype("int64"), "key long, parts long")
    rows = rows.join(F.broadcast(large), "key", "left")
    repeats = rows.filter("parts > 1").groupBy("key", "own").agg(*sums).filter(parts > 1).select("key", "own", F.lit(True).alias("repeats"))
    repeats = spark.createDataFrame(repeats.toPandas(), "key long, own long, repeats boolean")
    rows = rows.join(F.broadcast(repeats), ["key", "own"], "left")
    lot = F.when(F.col("repeats"), F.xxhash64("nth")).otherwise(F.col("own"))
    rows = rows.withColumn("part", F.when(F.col("parts") > 1, F.pmod(lot, "parts")).otherwise(-1))

    ranges = min(MOST_RANGES, max(4 * shards, n // RANGE_ROWS))
    weight = (F.col("bytes") / total + F.col("rows") / n) / 2
    chance = F.least(F.lit(1.0), weight * (ranges * SAMPLES_PER_RANGE))
    dice = (F.shiftright(F.xxhash64("key", F.lit(seed)), 11) + 2**52) / 2**53
    sample = texts.select("key", weight.alias("w"), chance.alias("p")).filter(dice < F.col("p")).toPandas()
    bounds = splitters(sample["key"].to_numpy(np.int64), (sample["w"] / sample["p"]).to_numpy(float), ranges)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    # a subdivided text has ranges of its own behind the range it falls in
    rows = rows.withColumn("range", range_of("key")).withColumn("alone", F.when(F.col("part") >= 0, F.col("key")).otherwise(-(2**62) * 2))
    place = ["range", "alone", "part"]
    found = rows.groupBy(*place).agg(*sums, F.min("key").alias("low"), F.max("key").alias("high")).toPandas().sort_values(place)
    found["rank"] = np.arange(len(found))
    found["before"] = found["bytes"].cumsum() - found["bytes"]
    found["steps"] = np.where((found["part"] < 0) & (found["rows"] > OVERFULL), found["rows"] // RANGE_ROWS, 1)
    known = spark.createDataFrame(found[[*place, "rank", "before", "low", "high", "steps"]].astype("int64"), "range long, alone long, part long, rank long, before long, low long, high long, steps long")
    step = F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low") + 1.0) * F.col("steps"))
    rows = rows.join(F.broadcast(known), place).withColumn("sub", F.least(step, F.col("steps") - 1)).select("_id", "size", "text_crc32", "key", "own", "nth", "rank", "before", "sub")

    piece = ["rank", "sub"]
    earlier = Window.partitionBy("rank").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    steps = rows.groupBy(*piece, "before").agg(F.sum("size").alias("bytes"))
    steps = _few(steps.select(*piece, (F.col("before") + F.coalesce(F.sum("bytes").over(earlier), F.lit(0))).alias("ahead")))

    def placed(df: DataFrame, size: str) -> DataFrame:
        """+ shard, from the middle of the row's text within the whole order. A subdivided text's part counts as one."""
        inside = Window.partitionBy(*piece).orderBy("key")
        earlier = F.coalesce(F.sum(size).over(inside.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = F.sum(size).over(inside.rangeBetween(0, 0))
        joined = df.join(steps, piece).withColumn("middle", F.col("ahead") + earlier + own / 2)
        return joined.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / total)).cast("int"))

    # a range lies in few shards, so the driver sees little more than its number of ranges
    counts = cut(placed(rows.groupBy(*piece, "key").agg(*sums), "bytes").groupBy(*piece, "shard").agg(F.sum("rows").alias("rows")))
    firsts = counts.groupBy("rank", "shard").agg(F.sum("rows").alias("rows")).toPandas().sort_values(["rank", "shard"])
    firsts["first"] = firsts.groupby("shard")["rows"].cumsum() - firsts["rows"]
    firsts = spark.createDataFrame(firsts[["rank", "shard", "first"]].astype("int64"), "rank long, shard long, first long")
    earlier = Window.partitionBy("rank", "shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("first") + F.coalesce(F.sum("rows").over(earlier), F.lit(0))
    starts = _few(counts.join(F.broadcast(firsts), ["rank", "shard"]).select(*piece, "shard", start.alias("start")))
    order = Window.partitionBy(*piece, "shard").orderBy("key", "_id", "own", "nth")
    return (
        placed(rows, "size")
        .withColumn("_nth", F.row_number().over(order) - 1)
        .join(starts, [*piece, "shard"])
        .select(
            F.col("_id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("start") + F.col("_nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
