"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Each document has a hash-random key, and within its source documents stand in key order. A source takes whole epochs
while its target allows, then the first documents in key order up to the exact remainder, cutting the last one. Where
the cut falls is found by prefix sums over ranges of keys: the totals of a source's ranges (a fixed number), then those of
the ranges inside the one that the budget ends in, then the keys there in order. Ranges before the cut are taken whole and those
behind it are not, so neither rows nor texts need a shuffle. Rows that share the cut's key (repeats of one document) are numbered
by the task that holds them and share the rest of the budget.

Defined cases: null or blank text has size 0 and takes 0; a null source is a source of its own, after all others;
rows that repeat an id and text share a key and count each; ids may repeat or be null; a very long text is one size, and is
cut if the budget ends in it; other columns pass through
apply_mix and are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, text_or_empty

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Bits of the key that each level of ranges reads: the last level orders about one in 2**20 of a source's rows.
LEVELS = ((54, 10), (44, 10))
#: Tables with a row for each source are broadcast up to so many.
MOST_BROADCAST = 100_000


def word_count(text):
    """Number of runs of characters other than white space: each run, with the white space behind it, becomes one mark."""
    marks = F.regexp_replace(text, r"[^ \t\n\x0B\f\r]++[ \t\n\x0B\f\r]*+", "x")
    return F.length(F.ltrim(marks, F.lit(SPACES))).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, _rows) -> + target. One row per source.

    Sources below their ceiling share what the ceilings leave in proportion to weight; in order of ceiling / weight
    the sources that reach theirs come first, so one pass over the sources finds the common level.
    """
    weighted = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).select(
        "source",
        "source_size",
        "_rows",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int")).alias("_w"),
        (F.col("source_size") * float(most)).alias("_top"),
    )
    by_level = Window.orderBy(F.col("_top") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (
        weighted.withColumn("_below", F.coalesce(F.sum("_top").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.sum("source_size").over(everything) - F.col("_below")) / F.col("_open"))
        .withColumn("_level", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_top"), F.struct(F.col("_below"), F.col("_level")))).over(everything)["_level"])
    )
    return level.select("source", "source_size", "_rows", F.least("_top", F.col("_level") * F.col("_w")).alias("target"))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return cut(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_or_empty(text_col)).alias("size"),
            _key(id_col, text_col, seed).alias("_key"),
            *_place(),
        )
    )


def _key(id_col: str, text_col: str, seed: int):
    return F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))


def _place():
    """The task and the order in it of a row that a checkpoint is about to hold."""
    return F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_nth")


class Budgets:
    """What each source takes: whole epochs, and the documents before a cut in key order.

    table: (_source, source_size, target, _epochs, _cut, _part, _ties): the key at the cut, the words that its rows
    take together, and how many they are.
    """

    def __init__(self, rows: DataFrame, weights=WEIGHTS, most: float = MOST_EPOCHS):
        sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
        budget = F.round("target").cast("long")
        epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
        goals = targets(sources, weights, most).select(F.col("source").alias("_source"), "source_size", "target", epochs.alias("_epochs"), budget.alias("_budget"))
        goals = cut(goals.withColumn("_left", F.col("_budget") - F.col("_epochs") * F.col("source_size")))
        self.few = goals.count() <= MOST_BROADCAST
        at = goals.select("_source", "_left", F.lit(0).cast("long").alias("_before"))
        inside = rows.select("source", "size", "_key")
        for shift, bits in LEVELS:
            digit = F.shiftright("_key", shift) if shift + bits == 64 else F.shiftright("_key", shift).bitwiseAND(F.lit(2**bits - 1))
            at = cut(self._ending(self.of(inside, at).withColumn("_digit", digit), "_digit"))
            inside = self.of(inside, at.select("_source", F.col("_digit").alias("_in"))).filter(digit == F.col("_in")).select("source", "size", "_key")
        last = self._ending(self.of(inside, at.drop("_digit")), "_key").select(
            F.col("_source").alias("_of"), F.col("_key").alias("_cut"), (F.col("_left") - F.col("_before")).alias("_part"), "_ties"
        )
        self.table = cut(goals.join(last, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of", "_budget", "_left"))

    def of(self, df: DataFrame, table: DataFrame) -> DataFrame:
        """df with its source's row of a table that has one for each."""
        return df.join(F.broadcast(table) if self.few else table, F.col("source").eqNullSafe(F.col("_source")))

    def _ending(self, rows: DataFrame, by: str) -> DataFrame:
        """The value of `by` at which a source's prefix sum passes what is left of its budget."""
        sums = rows.groupBy("_source", "_left", "_before", by).agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_ties"))
        ahead = F.coalesce(F.sum("_sum").over(Window.partitionBy("_source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("_before", F.col("_before") + ahead)
        return sums.filter((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_sum"))).drop("_sum")

    def before_cut(self):
        return F.coalesce(F.col("_key") < F.col("_cut"), F.lit(False))

    def at_cut(self):
        return F.coalesce(F.col("_key") == F.col("_cut"), F.lit(False))

    def shared(self, tied: DataFrame) -> DataFrame:
        """Rows at their source's cut, + _extra: how much of each row's words the budget still covers, in the order of
        _task and _nth. Tasks' totals come first, so each numbers its own rows."""
        sums = tied.groupBy(F.col("_source").alias("_of"), F.col("_task").alias("_by")).agg(F.sum("size").alias("_sum"))
        ahead = F.sum("_sum").over(Window.partitionBy("_of").orderBy("_by").rowsBetween(Window.unboundedPreceding, -1))
        offsets = sums.select("_of", "_by", F.coalesce(ahead, F.lit(0)).alias("_offset"))
        joined = tied.join(offsets, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_task") == F.col("_by")))
        own = Window.partitionBy("_source", "_task").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
        taken = F.col("_part") - F.col("_offset") - F.coalesce(F.sum("size").over(own), F.lit(0))
        return joined.withColumn("_extra", F.greatest(F.lit(0), F.least("size", taken))).drop("_of", "_by", "_offset")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: float = MOST_EPOCHS, seed: int = 17) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken."""
    rows = _rows(docs, id_col, text_col, source_col, seed)
    budgets = Budgets(rows, weights, most)
    joined = budgets.of(rows, budgets.table)
    tied = budgets.shared(joined.filter(budgets.at_cut()))
    rest = joined.filter(~budgets.at_cut()).withColumn("_extra", F.when(budgets.before_cut(), F.col("size")).otherwise(0))
    taken = (F.col("_epochs") * F.col("size") + F.col("_extra")).cast("long")
    columns = [F.col("_id").alias(id_col), "size", "source_size", "target", taken.alias("taken")]
    return rest.select(*columns).unionAll(tied.select(*columns))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: float = MOST_EPOCHS, seed: int = 17) -> DataFrame:
    """The mix as documents, with all their columns: each as many times as its epochs say; a cut document joins if half
    of it or more is taken. A row's copies follow from its own source and key."""
    rows = _rows(docs, id_col, text_col, source_col, seed)
    budgets = Budgets(rows, weights, most)
    own = [F.col(c).alias(f"_doc_{i}") for i, c in enumerate(docs.columns)]
    text = text_or_empty(text_col)
    keyed = docs.filter(text.rlike(r"[^ \t\n\x0B\f\r]")).select(*own, F.col(source_col).cast("string").alias("source"), _key(id_col, text_col, seed).alias("_key"))
    words = word_count(text_or_empty(f"_doc_{docs.columns.index(text_col)}"))
    keyed = budgets.of(keyed, budgets.table).withColumn("size", F.when(budgets.at_cut(), words))
    half = lambda extra: F.when(2 * extra >= F.col("size"), 1).otherwise(0)
    alone = ~budgets.at_cut() | (F.col("_ties") == 1)
    copies = F.col("_epochs") + F.when(budgets.before_cut(), 1).when(budgets.at_cut(), half(F.col("_part"))).otherwise(0)
    out = keyed.filter(alone).select(*[f"_doc_{i}" for i in range(len(own))], copies.alias("_copies"))
    if budgets.table.filter("_ties > 1").limit(1).count():
        # repeats of one document at a cut; written once, so that they keep their numbers
        tied = budgets.shared(cut(keyed.filter(~alone).select("*", *_place())))
        out = out.unionAll(tied.select(*[f"_doc_{i}" for i in range(len(own))], (F.col("_epochs") + half(F.col("_extra"))).alias("_copies")))
    again = out.filter("_copies > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return again.select(*[F.col(f"_doc_{i}").alias(c) for i, c in enumerate(docs.columns)])
