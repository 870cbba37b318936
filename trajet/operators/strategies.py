"""Tiers, context assembly and the compaction strategies as window plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_content
from .windows import before, naive_truncation, session, upto

#: Tokens that a stubbed summary of a chunk stands for.
STUB_TOKENS = 10


def tierize(df: DataFrame, budget: int) -> DataFrame:
    """+ tier, rejected_reason. Exactly one system message and a user message are needed, else the session passes through."""
    is_system, is_user = F.col("role") == "system", F.col("role") == "user"
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(session())
    first = lambda c: F.min(F.when(c, F.col("msg_idx"))).over(session())
    marked = df.withColumns({"_ns": count(is_system), "_nu": count(is_user), "_s": first(is_system), "_u": first(is_user)})
    reason = F.when(F.col("_ns") != 1, "not exactly one system message").when(F.col("_nu") == 0, "no user message")
    fixed = (F.col("msg_idx") == F.col("_s")) | (F.col("msg_idx") == F.col("_u"))
    taken = F.coalesce(F.sum(F.when(~fixed, F.col("tokens"))).over(before()), F.lit(0))
    tier = (
        F.when(F.col("rejected_reason").isNotNull(), "passthrough")
        .when(F.col("msg_idx") == F.col("_s"), "system")
        .when(F.col("msg_idx") == F.col("_u"), "first_user")
        .when(F.col("_taken") < budget, "recent")
        .otherwise("dropped")
    )
    return marked.withColumns({"rejected_reason": reason, "_taken": taken}).withColumn("tier", tier).drop("_ns", "_nu", "_s", "_u", "_taken")


def assemble(tiers: DataFrame) -> DataFrame:
    """System, first user, a note where messages were dropped, then the recent ones: + position."""
    rank = F.when(F.col("tier") == "system", 0).when(F.col("tier") == "first_user", 1).when(F.col("tier") == "note", 2).otherwise(3)
    kept = tiers.filter(F.col("tier").isin("system", "first_user", "recent")).select("session_id", "msg_idx", "tier")
    note = tiers.filter("tier = 'dropped'").select("session_id", F.lit(-1).cast("long").alias("msg_idx"), F.lit("note").alias("tier")).distinct()
    order = Window.partitionBy("session_id").orderBy(rank, "msg_idx")
    return kept.unionByName(note).withColumn("position", (F.row_number().over(order) - 1).cast("long"))


def compact(df: DataFrame, budget: int, observe: int) -> DataFrame:
    """Per session: tokens before and after, and whether an observer would fire. No language model is called."""
    kept = F.when(F.col("tier") != "dropped", F.col("tokens")).otherwise(0)
    total = F.sum("tokens")
    return (
        tierize(df, budget)
        .groupBy("session_id")
        .agg(
            total.alias("tokens_before"),
            F.sum(kept).alias("tokens_after"),
            F.count_if(F.col("tier") == "dropped").alias("n_dropped"),
            ((total >= observe) & F.max("rejected_reason").isNull()).alias("observer_fires"),
            F.max("rejected_reason").alias("rejected_reason"),
        )
    )


def chunks(df: DataFrame, size: int, keep: int) -> DataFrame:
    """+ chunk, verbatim: runs of `size` messages of which the last `keep` stay as they are."""
    order = Window.partitionBy("session_id").orderBy("msg_idx")
    numbered = df.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / size).cast("long"))
    return numbered.withColumn("verbatim", F.col("chunk") > F.max("chunk").over(session()) - keep)


def keep_last(df: DataFrame, n: int) -> DataFrame:
    """The last n messages of each role stay, earlier ones become stubs."""
    order = Window.partitionBy("session_id", "role").orderBy(F.col("msg_idx").desc())
    stub = F.format_string("[%s stub: chars=%d]", F.col("role"), F.length("text"))
    marked = df.withColumn("verbatim", F.row_number().over(order) <= n)
    return marked.withColumn("text", F.when(F.col("verbatim"), F.col("text")).otherwise(stub))


def type_budget(df: DataFrame, budget: int) -> DataFrame:
    """System first, then users (all, or the newest within three fifths of the budget), then what is left for assistants."""
    role = F.col("role")
    running = F.sum(F.when(role == "user", F.col("tokens")).otherwise(0)).over(upto())
    of = lambda r: F.coalesce(F.sum(F.when(role == r, F.col("tokens"))), F.lit(0))
    recent = F.coalesce(F.sum(F.when((role == "user") & (F.col("_run") <= int(0.6 * budget)), F.col("tokens"))), F.lit(0))
    sums = df.withColumn("_run", running).groupBy("session_id").agg(of("system").alias("system_used"), of("user").alias("_user"), of("assistant").alias("assistant_total"), recent.alias("_recent"))
    sums = sums.withColumn("after_system", F.greatest(F.lit(0), budget - F.col("system_used")).cast("long"))
    fits = F.col("_user") <= F.col("after_system")
    sums = sums.withColumn("user_used", F.when(fits, F.col("_user")).otherwise(F.col("_recent")))
    after = F.greatest(F.lit(0), F.col("after_system") - F.col("user_used")).cast("long")
    policy = F.when(F.col("assistant_total") == 0, "absent").when(F.col("assistant_total") <= after, "verbatim_under_residual").otherwise("rolling_over_residual")
    return sums.select(
        "session_id", "system_used", "after_system", "user_used",
        F.when(fits, "all_verbatim").otherwise("fallback_recent_verbatim_plus_1line").alias("user_policy"),
        "assistant_total", after.alias("after_user"), policy.alias("assistant_policy"),
    )


def compare(df: DataFrame, budget: int, size: int = 2, keep: int = 2) -> DataFrame:
    """Sessions and tokens left by strategy; summaries count STUB_TOKENS."""
    total = lambda x, c: x.groupBy("session_id").agg(F.sum(c).cast("long").alias("t"))
    parts = chunks(df, size, keep).groupBy("session_id", "chunk").agg(F.sum("tokens").alias("tokens"), F.any_value("verbatim").alias("verbatim"))
    left = F.least("assistant_total", "after_user")
    typed = type_budget(df, budget).select("session_id", (F.col("system_used") + F.col("user_used") + left).alias("t"))
    frames = {
        "full_context": total(df, "tokens"),
        "naive_truncation": total(naive_truncation(df, budget), "tokens"),
        "rolling_summary": total(parts, F.when(F.col("verbatim"), F.col("tokens")).otherwise(STUB_TOKENS)),
        "type_aware": typed,
    }
    rows = None
    for name, frame in frames.items():
        part = frame.select(F.lit(name).alias("strategy"), "t")
        rows = part if rows is None else rows.unionAll(part)
    return rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("sessions"), F.sum("t").alias("compacted_tokens"))


def flatten(df: DataFrame) -> DataFrame:
    """One transcript per session, in message order."""
    line = F.concat("role", F.lit(": "), "text")
    ordered = F.array_sort(F.collect_list(F.struct("msg_idx", line.alias("line"))))
    return df.groupBy("session_id").agg(ordered.alias("l"), F.count(F.lit(1)).alias("n")).select("session_id", F.array_join(F.col("l")["line"], "\n").alias("transcript"), "n")


def line_tail(lines: DataFrame, budget: int) -> DataFrame:
    """The newest observation lines within the budget, in their order."""
    newest = Window.partitionBy("session_id").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    kept = lines.withColumn("_t", F.sum(F.ceil(F.length("line") / 4)).over(newest)).filter(F.col("_t") <= budget)
    ordered = kept.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return ordered.select("session_id", F.array_join(F.col("l")["line"], "\n").alias("previous"), F.size("l").cast("long").alias("n_lines"))


def observer_prompt(df: DataFrame, previous: DataFrame) -> DataFrame:
    line = F.concat("role", F.lit(": "), text_content(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("msg_idx", line.alias("line"))))
    asked = F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("msg_idx")))
    recent = df.groupBy("session_id").agg(ordered.alias("l"), asked.alias("asked"))
    text = F.concat(
        F.lit("Recent messages:\n"), F.array_join(F.col("l")["line"], "\n"), F.lit("\n\nCurrent user query: "), F.coalesce("asked", F.lit("")),
        F.lit("\n\nPrevious observations:\n"), F.coalesce("previous", F.lit("")),
    )
    return recent.join(previous, "session_id", "left").select("session_id", text.alias("prompt"))
