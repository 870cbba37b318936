"""Roll-ups, statistics and checks over run records. Nested turns are read with higher-order functions, never exploded
unless a turn is the unit of the answer; every report is one aggregation over one scan."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["bench", "config_id", "seed"]
# Gates of the run checks.
ERR_RATE_GATE = 0.10
MIN_FOR_SPREAD = 3
HALT_AFTER, HALT_FACTOR = 20, 1.5
#: Ranges of a halting sweep that tasks sum on their own.
RANGES = 64
#: Blocks of eight draws that a resample's row stands for.
DRAWN_BLOCKS = 4_096


def fires(kind: str):
    """Whether any turn of a record has a compaction event of this type."""
    return F.exists("turns", lambda t: F.exists(t["compaction_events"], lambda e: e["type"] == kind))


def recalls():
    return F.exists("turns", lambda t: F.size(t["recall_events"]) > 0)


def cells(records: DataFrame) -> DataFrame:
    """One row per (bench, config, seed)."""
    return records.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("accuracy"),
        F.sum("cost_usd").alias("cost_usd"),
        (F.sum("n_errors") / F.count(F.lit(1))).alias("err_rate"),
        F.sum("judge_cost_usd").alias("judge_cost_usd"),
        F.count_if(fires("observer")).alias("obs_n"),
        F.count_if(fires("offload")).alias("off_n"),
        F.count_if(recalls()).alias("rec_n"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("cache_read").alias("cache_read_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def merge_turn_events(turns: DataFrame, events: DataFrame) -> DataFrame:
    """Events of a run join the turns of their index: (task_id, turn_index, compaction_events, recall_events, class_signal).

    events: (task_id, seq, kind, turn_index, payload). A turn's own array stays unless it is empty; of the class signals
    of a turn the last one wins and goes before the turn's own. Events of no turn are left out.
    """
    of = lambda kind: F.filter(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "payload")))), lambda e: e.isNotNull())["payload"]
    found = events.groupBy("task_id", "turn_index").agg(
        of("compaction").alias("_compactions"), of("recall").alias("_recalls"), F.max_by(F.when(F.col("kind") == "class_signal", F.col("payload")), F.when(F.col("kind") == "class_signal", F.col("seq"))).alias("_signal")
    )
    filled = lambda own, new: F.when(F.size(own) > 0, F.col(own)).otherwise(F.coalesce(new, F.array().cast("array<string>"))).alias(own)
    joined = turns.join(found, ["task_id", "turn_index"], "left")
    return joined.select("task_id", "turn_index", filled("compaction_events", "_compactions"), filled("recall_events", "_recalls"), F.coalesce("_signal", "class_signal").alias("class_signal"))


def mode_class(records: DataFrame) -> DataFrame:
    """(task_id, class): the most frequent signal over a task's turns, ties by name, null without any."""
    signals = records.select("task_id", F.explode_outer(F.filter(F.col("turns")["class_signal"], lambda s: s.isNotNull())).alias("class"))
    counted = signals.groupBy("task_id", "class").agg(F.count("class").alias("n"))
    best = Window.partitionBy("task_id").orderBy(F.col("n").desc(), "class")
    return counted.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").select("task_id", "class")


def class_breakdown(scored: DataFrame) -> DataFrame:
    """(class, score) -> n, mean and standard error by class; null counts as unknown."""
    n = F.count(F.lit(1))
    return scored.groupBy(F.coalesce("class", F.lit("unknown")).alias("class")).agg(
        n.alias("n"), F.avg("score").alias("mean_primary"), (F.coalesce(F.stddev_samp("score"), F.lit(0.0)) / F.sqrt(n)).alias("stderr")
    )


def nearest_rank(values, p: float):
    """The value at position round-half-even(p * (n - 1)) of a group, from the group's sorted values."""
    at = F.bround(F.lit(p) * (F.size(values) - 1)).cast("int")
    return F.element_at(F.array_sort(values), at + 1)


def percentiles(records: DataFrame, by: str, value: str) -> DataFrame:
    """Exact ranks without collecting a group: each value's rank range comes from running counts of distinct values."""
    counted = records.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    ranked = counted.withColumns({"_to": F.sum("c").over(order), "_n": F.sum("c").over(whole)})
    pick = lambda p: F.min(F.when(F.col("_to") > F.bround(F.lit(p) * (F.col("_n") - 1)), F.col(value)))
    lower = F.min(F.when(F.col("_to") > F.floor((F.col("_n") - 1) / 2), F.col(value)))
    upper = F.min(F.when(F.col("_to") > F.ceil((F.col("_n") - 1) / 2), F.col(value)))
    return ranked.groupBy(by).agg(F.max("_n").alias("n"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), ((lower + upper) / 2).alias("median"))


def cost_with_cache(inputs, cached, outputs, rate_in, rate_out, factor):
    """Cached tokens are part of the input and billed at a factor of its rate, 1 where none is given."""
    fresh = F.greatest(F.lit(0), inputs - cached)
    return (fresh * rate_in + cached * rate_in * F.coalesce(factor, F.lit(1.0)) + outputs * rate_out) / 1e6


def breaker(df: DataFrame, order: list, cost: str, total: int, budget: float, by: tuple = ()) -> DataFrame:
    """+ halted: true from the first row of a sweep (columns `by`) on at which its projected total leaves the budget behind.
    Rows of equal order count together; nulls come last in it. A sweep is cut into ranges of order's first column (a number
    or a time), and a range starts from the totals of those before it, so no sweep has to stand in one task. Only where a
    projection is so near the limit that the order of additions decides it are costs added one by one, over that sweep."""
    first = F.col(order[0])
    if df.schema[order[0]].dataType.typeName() == "timestamp_ntz":  # has no cast to a number
        first = F.unix_date(first.cast("date")) * 86_400 + F.hour(first) * 3_600 + F.minute(first) * 60 + F.second(first)
    key = first.cast("double")
    quantiles = F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 10_000)
    # at most RANGES numbers
    bounds = F.array(*[F.lit(b) for b in sorted(set(df.agg(quantiles).first()[0] or []))]).cast("array<double>")
    rows = df.withColumn("_range", F.when(key.isNull(), RANGES).otherwise(F.size(F.filter(bounds, lambda b: b < key))))
    parts = [*by, "_range"]
    in_order = [F.col(c).asc_nulls_last() for c in order]
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    w = Window.partitionBy(*parts).orderBy(*in_order).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def carried(rows: DataFrame, **sums) -> DataFrame:
        """+ for each name the aggregate over the sweep's earlier ranges."""
        totals = rows.groupBy(*parts).agg(*[s.alias(n) for n, s in sums.items()])
        before = totals.select(*[F.col(c).alias(f"_of_{c}") for c in parts], *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(n) for n in sums])
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in parts]
        return rows.join(before, same).drop(*[f"_of_{c}" for c in parts])

    limit = HALT_FACTOR * budget
    sizes = F.abs(F.col(cost))
    rows = carried(rows, _rows=F.count(F.lit(1)), _costs=F.count(cost), _spent=F.coalesce(F.sum(cost), F.lit(0.0)), _size=F.coalesce(F.sum(sizes), F.lit(0.0)))
    n, costs = F.col("_rows") + F.count(F.lit(1)).over(w), F.col("_costs") + F.count(cost).over(w)
    spent = F.col("_spent") + F.coalesce(F.sum(cost).over(w), F.lit(0.0))
    mean = F.when(costs > 0, spent / costs)
    trips = (n >= HALT_AFTER) & (mean * total > limit)
    # what additions in any order can be off by, twice
    slack = (costs + 4) * 4.5e-16 * (F.col("_size") + F.coalesce(F.sum(sizes).over(w), F.lit(0.0))) / costs * abs(total)
    near = (n >= HALT_AFTER) & (costs > 0) & (F.abs(mean * total - limit) <= slack)
    rows = carried(rows.withColumns({"_trips": trips, "_near": near}), _tripped=F.count_if("_trips"))
    halted = F.when(F.col("_tripped") > 0, True).otherwise(F.bool_or("_trips").over(w))
    rows = rows.withColumn("halted", halted).select(*df.columns, "halted", "_near")

    # few sweeps
    close = rows.filter("_near").select(*[F.col(c).alias(f"_of_{c}") for c in by]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] or [F.lit(True)]
    one_by_one = Window.partitionBy(*by).orderBy(*in_order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    trips = (F.count(F.lit(1)).over(one_by_one) >= HALT_AFTER) & (F.avg(cost).over(one_by_one) * total > limit)
    again = df.join(close, same, "left_semi").withColumn("_trips", trips).withColumn("halted", F.bool_or("_trips").over(one_by_one))
    return rows.join(close, same, "left_anti").select(*df.columns, "halted").unionByName(again.select(*df.columns, "halted"))


def draw(*parts):
    """A number below 2**32 from the parts' text: the same in every engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 8), 16, 10).cast("long")


#: Random bits of a SHA-256 that are used: four words of 60 bits, which fit a long in every engine.
WORD_BITS, WORDS = 60, 4


def permutation_test(diffs: DataFrame, n_perm: int = 10_000, seed: int = 42) -> DataFrame:
    """(task_id, diff) -> n, delta, p_value, p_pooled of the two-sided sign-flip test; without pairs both p are 1.

    Pairs of equal absolute difference are exchangeable, so only the number of plus signs among them counts: that of ones
    among as many random bits. A permutation reads bits, not pairs.
    """
    totals = diffs.agg(F.count("diff").alias("n"), F.coalesce(F.avg("diff"), F.lit(0.0)).alias("delta"), F.coalesce(F.sum("diff"), F.lit(0.0)).alias("s"))
    bits = WORD_BITS * WORDS
    sizes = diffs.filter("diff <> 0").groupBy(F.abs("diff").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    flips = sizes.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1)))).repartition("perm")
    flips = flips.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(k - 1) div {bits}"))))
    digest = F.sha2(F.concat_ws(":", F.format_string("%.9f", "v"), F.col("perm").cast("string"), F.col("block").cast("string"), F.lit(str(seed))), 256)
    flips = flips.withColumns({"h": digest, "left": F.col("k") - F.col("block") * bits})
    ones = F.lit(0)
    for w in range(WORDS):
        word = f"cast(conv(substring(h, {1 + w * WORD_BITS // 4}, {WORD_BITS // 4}), 16, 10) as bigint)"
        used = f"greatest(0, least({WORD_BITS}, left - {w * WORD_BITS}))"
        ones = ones + F.expr(f"bit_count(shiftright({word}, cast({WORD_BITS} - {used} as int)))")
    drawn = flips.groupBy("perm", "v", "k").agg(F.sum(ones).alias("plus")).groupBy("perm").agg(F.sum(F.col("v") * (2 * F.col("plus") - F.col("k"))).alias("x"))
    # n_perm rows, and one: constants of the test
    sums = diffs.sparkSession.range(n_perm).withColumnRenamed("id", "perm").join(drawn, "perm", "left").select(F.coalesce("x", F.lit(0.0)).alias("x"))
    extreme = sums.join(F.broadcast(totals)).agg(F.count_if(F.abs("x") >= F.abs("s") - 1e-12).alias("c"), F.max("n").alias("n"), F.max("delta").alias("delta"))
    return extreme.select("n", "delta", (F.col("c") / n_perm).alias("p_value"), ((F.col("c") + 1) / (n_perm + 1)).alias("p_pooled"))


#: Units that differences are tried as multiples of; else the largest difference is cut into as many steps as LATTICE allows.
UNITS = (1.0, 1 / 2, 1 / 4, 1 / 5, 1 / 8, 1 / 10, 1 / 16, 1 / 20, 1 / 25, 1 / 50, 1 / 100, 1 / 1000)
#: Points of the lattice that sums are held on, and standard deviations beyond which nothing is left of them.
LATTICE, REACH = 2**17, 8
#: Points of the lattice of resampled sums: each is summed over the frequencies that are left, at most half as many.
RESAMPLED = 2**14


def lattice_unit(n: int, largest: float, squares: float, fits: list[bool]) -> float:
    """The unit of a lattice for n differences: one that holds them all exactly, if the sums then fit it, else a step fine
    enough that rounding moves the sums' spread by a part in a few hundred at most."""
    steps = max(1, int(LATTICE * largest / (4 * REACH * squares**0.5)))
    exact = next((u for u, ok in zip(UNITS, fits) if ok), None)
    return exact if exact and largest / exact <= steps else largest / steps


def sign_flip_test(diffs: DataFrame, n_perm: int = 10_000) -> DataFrame:
    """(diff) -> n, delta, p_value, p_pooled of the two-sided sign-flip test over all 2**n flips, instead of a sample.

    The flipped sums' distribution is a convolution; its characteristic function is a product of cosines, one for each
    distinct difference to the power of its count, and the tail comes from it by one sum over frequencies. Differences are
    multiples of a lattice's unit, exactly if a usual unit fits them, else rounded; their number does not matter beyond one
    grouping of them, since a lattice has at most LATTICE sums and few steps. p_pooled is what a sample of n_perm would
    give on average, its own order counted. Null differences are left out; without any, both p are 1.
    """
    d, size = F.col("diff").cast("double"), F.abs(F.col("diff").cast("double"))
    fits = [F.coalesce(F.bool_and(F.abs(d / u - F.round(d / u)) < 1e-9), F.lit(False)).alias(f"u{i}") for i, u in enumerate(UNITS)]
    # one row
    f = diffs.agg(F.count("diff").alias("n"), F.coalesce(F.avg(d), F.lit(0.0)).alias("delta"), F.coalesce(F.max(size), F.lit(0.0)).alias("largest"), F.coalesce(F.sum(d * d), F.lit(0.0)).alias("squares"), F.abs(F.coalesce(F.sum(d), F.lit(0.0))).alias("sum"), *fits).first()
    spark = diffs.sparkSession
    result = lambda p: spark.createDataFrame([(f["n"], f["delta"], p, (p * n_perm + 1) / (n_perm + 1))], "n long, delta double, p_value double, p_pooled double")
    if not f["largest"]:
        return result(1.0)
    unit = lattice_unit(f["n"], f["largest"], f["squares"], [f[f"u{i}"] for i in range(len(UNITS))])
    # at most LATTICE / REACH steps, of which each has been seen
    counts = diffs.filter("diff is not null").groupBy(F.round(size / unit).cast("long").alias("q")).agg(F.count(F.lit(1)).alias("k")).filter("q > 0")
    h = counts.agg(F.sum(F.col("q") * F.col("k")), F.sqrt(F.sum(F.col("q") * F.col("q") * F.col("k")).cast("double")), F.collect_list(F.struct(F.col("q").cast("double").alias("q"), F.col("k").cast("double").alias("k")))).first()
    total, spread, steps = h
    # the sum seen, in spreads, as rounding moves it and the spread alike; on an exact lattice these are whole numbers
    seen = round(f["sum"] / f["squares"] ** 0.5 * spread) if total else 0
    if seen == 0:
        return result(1.0)
    if seen > 2 * REACH * spread:
        return result(0.0)
    points = 2 * min(total, int(min(seen, REACH * spread) + REACH * spread) + 1) + 1
    row = spark.createDataFrame([(steps,)], "steps array<struct<q:double,k:double>>")
    theta = F.col("id") * F.lit(2 * 3.141592653589793 / points)
    c = lambda x: F.cos(x["q"] * F.col("theta"))
    grown = F.aggregate(
        "steps", F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("turns")),
        lambda a, x: F.struct((a["log"] + x["k"] * F.ln(F.greatest(F.abs(c(x)), F.lit(1e-300)))).alias("log"), (a["turns"] + F.when(c(x) < 0, x["k"]).otherwise(0.0)).alias("turns")),
    )
    waves = spark.range(1, points // 2 + 1).withColumn("theta", theta).join(F.broadcast(row)).withColumn("g", grown)
    wave = F.when(F.col("g.turns") % 2 == 1, -1.0).otherwise(1.0) * F.exp("g.log")
    inner = F.sum(wave * F.sin((seen - 0.5) * F.col("theta")) / F.sin(F.col("theta") / 2))
    # all sums nearer to zero than the one seen
    nearer = (2 * seen - 1 + 2 * F.coalesce(inner, F.lit(0.0))) / points
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - nearer))
    return waves.agg(p.alias("p_value")).select(F.lit(f["n"]).cast("long").alias("n"), F.lit(f["delta"]).alias("delta"), "p_value", ((F.col("p_value") * n_perm + 1) / (n_perm + 1)).alias("p_pooled"))


def resampled_interval(scores: DataFrame, reps: int = 10_000, alpha: float = 0.05) -> DataFrame:
    """(score) -> accuracy, lo, hi: the interval that the percentile method gives over resamples of all n rows with
    replacement, from the resampled mean's own distribution instead of a sample of it. reps fixes which order statistics
    bound the interval, as they would among so many resamples. Any scores, fractional too.

    The sum of n draws is an n-fold convolution of the scores' distribution on a lattice; its characteristic function is
    that of one draw to the power n, and few frequencies are left of it. Scores are multiples of a usual unit, else rounded
    to a step and the result scaled back to their mean and spread. Rows are grouped once; nothing after that depends on
    their number but the power. Null scores are left out; without any, all three are 0.
    """
    spark = scores.sparkSession
    v = F.col("score").cast("double")
    fits = [F.coalesce(F.bool_and(F.abs(v / u - F.round(v / u)) < 1e-9), F.lit(False)).alias(f"u{i}") for i, u in enumerate(UNITS)]
    # one row
    f = scores.agg(F.count("score").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("sd"), *fits).first()
    n, result = f["n"], lambda *x: spark.createDataFrame([tuple(map(float, x))], "accuracy double, lo double, hi double")
    if not n or f["least"] == f["most"]:
        return result(*[f["mean"] or 0.0] * 3)
    width = f["most"] - f["least"]
    steps = max(1, int(RESAMPLED * width / (2 * REACH * f["sd"] * n**0.5)))
    exact = next((u for i, u in enumerate(UNITS) if f[f"u{i}"]), None)
    unit = exact if exact and width / exact <= steps else width / steps
    # at most n values, and RESAMPLED / REACH steps
    shares = scores.filter("score is not null").groupBy(F.round((v - f["least"]) / unit).cast("double").alias("q")).agg((F.count(F.lit(1)) / n).alias("p"))
    h = shares.agg(F.sum(F.col("q") * F.col("p")), F.sqrt(F.sum(F.col("q") * F.col("q") * F.col("p")) - F.pow(F.sum(F.col("q") * F.col("p")), F.lit(2))), F.max("q"), F.collect_list(F.struct("q", "p"))).first()
    mean, sd, top, values = h
    reach = REACH * sd * n**0.5 + 1
    first, last = max(0, int(n * mean - reach)), min(int(n * top), int(n * mean + reach) + 1)
    points = (last - first + 1) | 1
    one = spark.createDataFrame([(values,)], "vs array<struct<q:double,p:double>>")
    theta = F.col("id") * F.lit(2 * 3.141592653589793 / points)
    add = lambda wave: F.aggregate("vs", F.lit(0.0), lambda a, x: a + x["p"] * wave(x["q"] * F.col("theta")))
    waves = spark.range(1, points // 2 + 1).withColumn("theta", theta).join(F.broadcast(one)).select("theta", add(F.cos).alias("re"), add(F.sin).alias("im"))
    size = F.exp(n * F.ln(F.greatest(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), F.lit(1e-300))))
    waves = waves.select("theta", size.alias("size"), (n * F.atan2("im", "re")).alias("turn")).filter("size > 1e-18")
    # what is left: some dozens, or half the lattice's points if n is small
    few = waves.agg(F.collect_list(F.struct("theta", "size", "turn")).alias("ws"))
    m = (F.col("id") + 1).cast("double")  # sums from `first` on
    turned = lambda a, w: a + w["size"] * F.cos(w["turn"] - w["theta"] * (F.lit(float(first)) + F.col("id") / 2)) * F.sin(m * w["theta"] / 2) / F.sin(w["theta"] / 2)
    below = (m + 2 * F.aggregate("ws", F.lit(0.0), turned)) / points
    sums = spark.range(points).join(F.broadcast(few)).select((F.col("id") + first).alias("x"), below.alias("below"))
    at = lambda share: F.min(F.when(F.col("below") >= (int(share * reps) + 1) / reps - 1e-12, F.col("x")))
    value = lambda x: F.lit(f["mean"]) + (x / n - mean) * (f["sd"] / sd)
    return sums.agg(F.lit(f["mean"]).alias("accuracy"), value(at(alpha / 2)).alias("lo"), value(at(1 - alpha / 2)).alias("hi"))


def _hits(seed: int, most: int):
    """(rep, n, k, block) -> rep, n, k, hits: the draws below k of so many blocks from this one on, eight a digest."""
    tail = f":{seed}".encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for rep, n, k, block in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "k", "block"))):
                head, end = sha256(b"%d:" % rep), min(block + most, (n + 7) // 8)
                digests = []
                for b in range(block, end):
                    h = head.copy()
                    h.update(b"%d%b" % (b, tail))
                    digests.append(h.digest())
                draws = np.frombuffer(b"".join(digests), ">u4")[: max(0, n - 8 * block)].astype("u4")
                hits.append(int(np.count_nonzero(draws % np.uint32(n) < k)) if n else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "n", "k")), pa.array(hits, pa.int64())], ["rep", "n", "k", "hits"])

    return run


def bootstrap(scores: DataFrame, reps: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(score) 0/1 rows -> accuracy, lo, hi by the percentile method; zeros without rows. Only the number of ones matters,
    so a draw is a hit when its index falls among them; no row is joined, and a digest gives eight draws."""
    spark = scores.sparkSession
    totals = scores.agg(F.count("score").alias("n"), F.coalesce(F.sum("score"), F.lit(0.0)).cast("long").alias("k"))
    # ranges of blocks, so that few rows travel however many draws they stand for
    ranges = F.expr(f"explode(sequence(0L, greatest(n - 1, 0L) div 8, {DRAWN_BLOCKS}L))")
    drawn = spark.range(reps).withColumnRenamed("id", "rep").join(F.broadcast(totals)).select("rep", "n", "k", ranges.alias("block"))
    means = drawn.mapInArrow(_hits(seed, DRAWN_BLOCKS), "rep long, n long, k long, hits long").groupBy("rep", "n", "k").agg(F.sum("hits").alias("hits"))
    means = means.select(F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("m"), F.coalesce(F.try_divide("k", "n"), F.lit(0.0)).alias("a"))
    # reps rows
    ranked = means.withColumn("_rn", F.row_number().over(Window.orderBy("m")) - 1)
    at = lambda i: F.max(F.when(F.col("_rn") == i, F.col("m")))
    return ranked.agg(F.max("a").alias("accuracy"), at(int(alpha / 2 * reps)).alias("lo"), at(int((1 - alpha / 2) * reps)).alias("hi"))


def wilson(k, n, z: float = 1.96):
    p = k / n
    mid, span = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(F.lit(0.0), (mid - span) / (1 + z * z / n)), F.least(F.lit(1.0), (mid + span) / (1 + z * z / n))


def issues(records: DataFrame) -> DataFrame:
    """(severity, path, check) rows: bad records and bad cells."""
    issue = lambda severity, check: F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"))
    tokens = F.col("input_tokens") + F.col("output_tokens")
    cost = F.col("cost_usd")
    bad_cost = cost.isNull() | F.isnan(cost) | (cost < 0) | (cost == float("inf"))
    row = F.array(
        F.when(tokens <= 0, issue("error", "no tokens")),
        F.when(bad_cost, issue("error", "cost not finite or negative")).when((cost == 0) & (tokens > 0), issue("warn", "cost is zero")),
        F.when(F.col("score").isNull() | F.isnan("score"), issue("error", "score not finite")),
    )
    path = F.concat_ws("/", "bench", "config_id", F.col("seed").cast("string"))
    of_rows = records.select(path.alias("path"), "task_id", F.explode(F.filter(row, lambda x: x.isNotNull())).alias("i")).select("i.severity", F.concat("path", F.lit("#"), F.col("task_id").cast("string")).alias("path"), "i.check")
    per_cell = records.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), (F.sum("n_errors") / F.count(F.lit(1))).alias("err"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("sd"),
        F.count_if(fires("observer") | fires("offload")).alias("events"),
    )
    cell = F.array(
        F.when(F.col("err") >= ERR_RATE_GATE, issue("error", "error rate")),
        F.when((F.col("n") >= MIN_FOR_SPREAD) & (F.col("sd") == 0), issue("warn", "constant scores")),
        F.when((F.col("n") >= MIN_FOR_SPREAD) & (F.col("events") == 0), issue("warn", "no compaction events")),
    )
    of_cells = per_cell.select(path.alias("path"), F.explode(F.filter(cell, lambda x: x.isNotNull())).alias("i")).select("i.severity", "path", "i.check")
    return of_rows.unionAll(of_cells)


def stratified(df: DataFrame, by: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Largest-remainder quotas by stratum; within one, the first rows in hash order."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("c"))
    raw = F.lit(n) * F.col("c") / F.sum("c").over(Window.partitionBy())
    rest = raw - F.floor(raw)
    rank = F.row_number().over(Window.orderBy(F.col("_rest").desc(), by))
    quotas = (
        counts.withColumns({"_base": F.floor(raw).cast("long"), "_rest": F.round(rest, 9)})
        .withColumn("_left", n - F.sum("_base").over(Window.partitionBy()))
        .withColumn("quota", F.col("_base") + F.when(rank <= F.col("_left"), 1).otherwise(0))
        .select(by, "quota")
    )
    return _first_by_hash(df, quotas, by, id_col, seed)


def equal_split(df: DataFrame, by: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """floor(n / k) of each stratum, one more for the first ones by name."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("c"))
    k = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(by)) - 1
    quotas = counts.select(by, (F.floor(F.lit(n) / k) + F.when(rank < F.lit(n) % k, 1).otherwise(0)).alias("quota"))
    return _first_by_hash(df, quotas, by, id_col, seed)


def _first_by_hash(df, quotas, by, id_col, seed):
    order = Window.partitionBy(by).orderBy(F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))), 256))
    return df.withColumn("_rn", F.row_number().over(order)).join(quotas, by).filter(F.col("_rn") <= F.col("quota")).drop("_rn", "quota")


def spearman(a: DataFrame, b: DataFrame, item: str, score: str) -> DataFrame:
    """1 - 6 * sum(d^2) / (n (n^2 - 1)) on ordinal ranks by descending score, ties by name."""
    order = Window.orderBy(F.col(score).desc(), item)
    rank = lambda x, name: x.select(item, F.row_number().over(order).alias(name))
    n = F.count(F.lit(1))
    return rank(a, "ra").join(rank(b, "rb"), item).agg((1 - 6 * F.sum(F.pow(F.col("ra") - F.col("rb"), 2)) / (n * (n * n - 1))).alias("rho"), n.alias("n"))


def sign_agreement(scores: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """Over unordered pairs of items: how often both scores order the pair alike. Items are a short list (strategies)."""
    left, right = scores.alias("l"), F.broadcast(scores).alias("r")
    pairs = left.join(right, F.col(f"l.{item}") < F.col(f"r.{item}"))
    alike = F.signum(F.col(f"l.{a}") - F.col(f"r.{a}")) == F.signum(F.col(f"l.{b}") - F.col(f"r.{b}"))
    return pairs.agg(F.count_if(alike).alias("pair_matches"), F.count(F.lit(1)).alias("pair_total"))


def summary_issues(cells: DataFrame, summaries: DataFrame) -> DataFrame:
    """Cells without a summary, with an empty or a partial one: (severity, path, check)."""
    have = summaries.select(*CELL, "n_completed", "status", F.lit(True).alias("_there"))
    path = F.concat_ws("/", "bench", "config_id", F.col("seed").cast("string"))
    issue = lambda severity, check: F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"))
    found = F.array(
        F.when(F.col("_there").isNull(), issue("warn", "summary missing")),
        F.when(F.col("n_completed") == 0, issue("error", "nothing completed")),
        F.when(F.col("status") == "partial", issue("warn", "partial")),
    )
    rows = cells.select(*CELL).distinct().join(have, CELL, "left")
    return rows.select(path.alias("path"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("i.severity", "path", "i.check")


def judge_issues(records: DataFrame, judged: list[str]) -> DataFrame:
    """Records of judged benches with neither a judge cost nor an explanation; a cached verdict has the latter."""
    cost, said = F.col("judge_cost_usd"), F.coalesce("judge_explanation", F.lit(""))
    bad_cost = cost.isNull() | F.isnan(cost) | (cost < 0)
    stub = said.isin("", "judge-stub")
    return records.filter(F.col("bench").isin(judged) & bad_cost & stub).select("bench", "task_id", F.lit("warn").alias("severity"), F.lit("no judge evidence").alias("check"))


def calibrate(traces: DataFrame, grid: list[float]) -> DataFrame:
    """Extension: (trace_id, size, useful) -> for each threshold of a short grid its cost and benefit, and whether no
    other threshold is at least as good on both and better on one."""
    points = traces.select("trace_id", "size", "useful", F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    goes = F.col("size") > F.col("threshold")
    sums = points.groupBy("threshold").agg(F.sum(F.when(goes, F.col("size")).otherwise(0)).alias("saved"), F.count_if(goes & F.col("useful")).alias("lost"))
    # one row per grid point
    a, b = sums.alias("a"), F.broadcast(sums.select(F.col("saved").alias("s"), F.col("lost").alias("l")))
    beaten = a.join(b, (F.col("s") >= F.col("saved")) & (F.col("l") <= F.col("lost")) & ((F.col("s") > F.col("saved")) | (F.col("l") < F.col("lost"))), "left_anti")
    return sums.join(beaten.select("threshold", F.lit(True).alias("on_front")), "threshold", "left").fillna(False, ["on_front"])
