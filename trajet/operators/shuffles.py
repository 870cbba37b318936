"""Shuffles by swaps, exactly as a loop from the end would make them, without the loop.

Step i (from the last place down to 1) swaps places i and j(i) <= i. What ends at place i stood at j(i) before that step;
a place q holds there what the nearest earlier step k > i with j(k) = q brought, which is what stood at k before step k, or
else its own first row. So every place points to one later place at most, the pointers end at a first row, and doubling
them a few times finds it: as many joins as the logarithm of the longest chain, which is itself about the logarithm of the
number of rows. Pools are shuffled side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.generators import draw


def _kept(df: DataFrame) -> DataFrame:
    """Rows stay as they are computed; lineage ends where the session has a checkpoint folder."""
    has_folder = df.sparkSession.sparkContext.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    return df.checkpoint() if has_folder else df.persist()


def numbered(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """+ the row's number from 0 in this order, over the whole table, without gathering it: a sort by ranges and one count
    a partition."""
    tag = f"_{name}_in"
    held = _kept(df.orderBy(*order).withColumns({tag: F.monotonically_increasing_id()}))
    part, row = F.shiftright(tag, 33), F.col(tag).bitwiseAND(F.lit((1 << 33) - 1))
    # one row a partition
    counts = sorted((r["p"], r["n"]) for r in held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in counts:
        starts.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    return held.join(F.broadcast(offsets), part == F.col("_p")).withColumn(name, F.col("_start") + row).drop("_p", "_start", tag)


def shuffled(rows: DataFrame, seed: int, pool: str = "pool", place: str = "place", size: str = "size", base: str = "base") -> DataFrame:
    """Rows with their pool, place in it (from 0), the pool's size and the number of draws taken before it -> + shuffled,
    the place after the shuffle. A pool of n rows takes n - 1 draws; a step takes the draw times its place plus one, cut."""
    i = F.col(place).cast("long")
    swaps = rows.filter(i > 0).select(F.col(pool).alias("p"), i.alias("i"), F.floor(draw(seed, F.col(base) + F.col(size) - 1 - i) * (i + 1)).alias("j"))
    swaps = _kept(swaps.withColumn("next", F.lead("i").over(Window.partitionBy("p", "j").orderBy("i"))))
    later = swaps.filter("i > j").groupBy("p", F.col("j").alias("k")).agg(F.min("i").alias("to"))
    links = rows.select(F.col(pool).alias("p"), i.alias("k")).join(later, ["p", "k"], "left").select("p", "k", F.coalesce("to", "k").alias("to"))
    links = _kept(links)
    while True:
        ends = links.select("p", F.col("k").alias("to"), F.col("to").alias("end"))
        fresh = _kept(links.join(ends, ["p", "to"]).select("p", "k", "to", "end"))
        moved = fresh.filter("end <> to").limit(1).count()
        links = fresh.select("p", "k", F.col("end").alias("to"))
        if not moved:
            break
    # what stands at place i in the end: the row of j(i), or where the chain from its next step ends
    starts = swaps.select("p", F.col("i").alias("at"), "j", F.col("next").alias("k"))
    zero = rows.filter(i == 0).select(F.col(pool).alias("p"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("j"), F.lit(0).cast("long").alias("k"))
    came = starts.unionAll(zero).join(links, ["p", "k"], "left").select("p", "at", F.coalesce("to", "j").alias("origin"))
    return rows.join(came.select(F.col("p").alias(pool), F.col("origin").alias(place), F.col("at").alias("shuffled")), [pool, place])


def stratified_shuffle(df: DataFrame, by: str, order: str, n: int, seed: int) -> DataFrame:
    """A sample of n rows in shares of the strata, as one generator draws it: the strata in the order of their first rows
    are shuffled one after the other, their first rows by quota are put together and shuffled again. + place.

    Quotas are floors of the exact shares, and the rest goes to the largest remainders, earlier strata first.
    """
    rows = numbered(df.select(by, order), order, name="_row")
    w = Window.partitionBy(by).orderBy("_row")
    # one row a stratum
    strata = rows.groupBy(by).agg(F.count(F.lit(1)).alias("size"), F.min("_row").alias("_first"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    raw = F.col("size") * n / F.sum("size").over(everything)
    strata = strata.withColumns({"_floor": F.floor(raw), "_rest": raw - F.floor(raw), "base": F.coalesce(F.sum(F.col("size") - 1).over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), "_first"))
    strata = strata.withColumns({"quota": F.col("_floor") + (rank <= n - F.sum("_floor").over(everything)).cast("int"), "_drawn": F.sum(F.col("size") - 1).over(everything)})
    pools = rows.withColumn("place", F.row_number().over(w) - 1).join(F.broadcast(strata), by).withColumn("pool", F.col("_first"))
    taken = shuffled(pools, seed).filter(F.col("shuffled") < F.least("quota", "size")).select(by, order, "pool", F.col("shuffled").alias("_in_pool"), "_drawn")
    # n rows
    sample = taken.withColumns({"place": F.row_number().over(Window.orderBy("pool", "_in_pool")) - 1, "size": F.count(F.lit(1)).over(everything), "pool": F.lit(0), "base": F.col("_drawn")})
    return shuffled(sample, seed).select(by, order, F.col("shuffled").alias("place"))
