"""Trees of rules of any depth, orders by collation, and thresholds that are judged on what they were not fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shuffles import _kept


def levels(nodes: DataFrame, by: str = "task_id", node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """(by, node, parent null at a root) -> + level, the steps to the root. Pointers to parents are doubled, so the rounds
    are the logarithm of the depth. A tree with a cycle, or a parent that is not there, raises ValueError and names it."""
    start = nodes.select(F.col(by).alias("t"), F.col(node).alias("n"), F.coalesce(F.col(parent), F.col(node)).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("level"), F.col(parent).isNull().alias("done"))
    links = _kept(start)
    most = links.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, most).bit_length() + 1):
        above = links.select("t", F.col("n").alias("up"), F.col("up").alias("end"), F.col("level").alias("more"), F.col("done").alias("at_root"))
        links = _kept(links.join(above, ["t", "up"], "left").select("t", "n", F.coalesce("end", "up").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), (F.col("done") | F.coalesce("at_root", F.lit(False))).alias("done")))
        if not links.filter("not done").limit(1).count():
            break
    else:
        bad = links.filter("not done").orderBy("t", "n").first()
        if bad:
            raise ValueError(f"{by} {bad['t']}: {node} {bad['n']} leads to no root")
    found = links.select(F.col("t").alias(by), F.col("n").alias(node), "level")
    return nodes.join(found, [by, node])


def rule_scores(nodes: DataFrame) -> DataFrame:
    """(task_id, node_id, parent_id, rule, score) -> (task_id, score) of each root, bottom up over any depth.

    Nodes without a rule are leaves with a score (null counts as 0). all: 1 if every child is 1 or more; any: 1 if one is;
    mean: the mean of the children. A rule over nothing: all 1, any and mean 0. Node ids are unique in a task.
    """
    placed = _kept(levels(nodes))
    deepest = placed.agg(F.max("level")).first()[0]
    if deepest is None:
        return nodes.select("task_id", F.lit(0.0).alias("score"))
    scored = None
    for level in range(deepest, -1, -1):
        at = placed.filter(F.col("level") == level).select("task_id", "node_id", "parent_id", "rule", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
        if scored is not None:
            below = scored.groupBy("task_id", F.col("parent_id").alias("node_id")).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("mean"))
            at = at.join(below, ["task_id", "node_id"], "left")
        else:
            at = at.withColumns({c: F.lit(None).cast("double") for c in ("lo", "hi", "mean")})
        flag = lambda c, nothing: F.when(F.coalesce(c >= 1, F.lit(nothing)), 1.0).otherwise(0.0)
        score = F.when(F.col("rule").isNull(), F.col("score")).when(F.col("rule") == "all", flag(F.col("lo"), True)).when(F.col("rule") == "any", flag(F.col("hi"), False)).otherwise(F.coalesce("mean", F.lit(0.0)))
        scored = at.select("task_id", "node_id", "parent_id", score.alias("score"))
    return scored.select("task_id", "score")


def collated(*columns: str, collation: str = "UNICODE") -> list:
    """Sort keys of text columns as a reader expects them: letters before accents before case (small first), then code
    points, so that equal keys are equal texts; nulls first."""
    keys = [F.collate(F.col(c), collation).asc_nulls_first() for c in columns]
    return [*keys, *(F.col(c).asc_nulls_first() for c in columns)]


def calibrate_left_out(traces: DataFrame, grid: list[float]) -> DataFrame:
    """(trace_id, size, useful) -> for each trace and threshold: what the threshold saves and loses over all other traces,
    whether it is on their front (no other threshold is at least as good on both and better on one), and what it then
    saves and loses on the trace itself.

    Totals are taken once; a fold's are those less its own. Rows are traces times the grid's few thresholds. Null sizes
    and null marks go nowhere and are not useful.
    """
    goes = lambda t: F.coalesce(F.col("size") > t, F.lit(False))
    useful = F.coalesce("useful", F.lit(False))
    own = traces.groupBy("trace_id").agg(*(F.sum(F.when(goes(t), F.col("size")).otherwise(0)).cast("double").alias(f"s{i}") for i, t in enumerate(grid)), *(F.count_if(goes(t) & useful).alias(f"l{i}") for i, t in enumerate(grid)))
    total = own.agg(*(F.sum(f"{c}{i}").alias(f"{c}{i}_all") for c in "sl" for i in range(len(grid))))
    fold = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"s{i}_all") - F.col(f"s{i}")).alias("saved"), (F.col(f"l{i}_all") - F.col(f"l{i}")).alias("lost"), F.col(f"s{i}").alias("own_saved"), F.col(f"l{i}").alias("own_lost")) for i, t in enumerate(grid)))
    # one row of totals
    folds = own.join(F.broadcast(total)).select("trace_id", fold.alias("fold"))
    beaten = lambda x: F.exists("fold", lambda y: (y["saved"] >= x["saved"]) & (y["lost"] <= x["lost"]) & ((y["saved"] > x["saved"]) | (y["lost"] < x["lost"])))
    marked = F.transform("fold", lambda x: x.withField("on_front", ~beaten(x)))
    return folds.select("trace_id", F.inline(marked)).select("trace_id", "threshold", "saved", "lost", "on_front", "own_saved", "own_lost")
