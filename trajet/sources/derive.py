"""Trajectory and run tables derived from the driver's tables, in Spark and as DuckDB CTEs that say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import char_tokens, content_bytes

TOOLS = ("web_search", "visit_webpage", "python_exec", "text_editor", "describe_image")
STRATEGIES = ("full_context", "naive_truncation", "rolling_summary", "type_aware", "task_aware")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str, counter=char_tokens) -> DataFrame:
    """(session_id, msg_idx, role, text, tokens); counter: a text column's tokens."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("msg_idx"), "role", "text", counter(F.col("text")).alias("tokens")
    )


MESSAGES = """m AS (
    SELECT conv_id AS session_id, turn AS msg_idx, role, text, ceil(length(text) / 4.0)::BIGINT AS tokens FROM conversations)"""


def with_turns(df: DataFrame) -> DataFrame:
    """+ turn_index, step_index: user messages open turns, others take steps; before the first user the turn is 0.

    Every message counts as a step, system messages too, but these get no indices themselves.
    """
    order = Window.partitionBy("session_id").orderBy("msg_idx")
    users = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_users", users)
    within = Window.partitionBy("session_id", "_users").orderBy("msg_idx")
    step = F.row_number().over(within) - F.when(F.col("_users") > 0, 1).otherwise(0)
    is_system = F.col("role") == "system"
    return df.withColumns(
        {
            "turn_index": F.when(~is_system, F.greatest(F.lit(0), F.col("_users") - 1)).cast("long"),
            "step_index": F.when(~is_system, step).cast("long"),
        }
    ).drop("_users")


def turns_sql(source: str) -> str:
    return f"""SELECT * EXCLUDE (users),
        CASE WHEN role <> 'system' THEN greatest(0, users - 1) END::BIGINT AS turn_index,
        CASE WHEN role <> 'system' THEN row_number() OVER (PARTITION BY session_id, users ORDER BY msg_idx) - CASE WHEN users > 0 THEN 1 ELSE 0 END END::BIGINT AS step_index
    FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY msg_idx) AS users FROM {source})"""


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with tool traffic from the event stream, one part a message:
    (session_id, msg_idx, role, part_type, use_id, tool_name, text, payload_len, bytes, ts, value, turn_index, step_index)"""
    g, v, kind = F.col("user_id") % 3, F.col("value"), F.col("event_type")
    low = (g == 1) & (v < 30)
    part = (
        F.when((kind == "click") & ~((g == 0) | low), "tool_use")
        .when((kind == "purchase") & ~((g == 0) | low), "tool_result")
        .otherwise("text")
    )
    role = (
        F.when(part == "tool_use", "assistant")
        .when(part == "tool_result", "tool")
        .when((kind == "signup") | (kind.isin("view", "purchase") & (g == 0)) | ((kind == "click") & ((g == 0) | low)), "user")
        .otherwise("assistant")
    )
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    by_part = Window.partitionBy("session_id", "part_type").orderBy("ts", "event_id")
    df = (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("session_id"), "event_id", "ts", "value", role.alias("role"), part.alias("part_type"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("text"))
        .withColumn("msg_idx", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("_k", F.row_number().over(by_part))
    )
    is_part = F.col("part_type") != "text"
    use_id = F.when(is_part, F.concat(F.lit("t"), F.col("_k").cast("string")))
    payload = F.when(F.col("part_type") == "tool_result", F.floor(F.col("value") * 100)).otherwise(0).cast("long")
    result_json = F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"), F.col("use_id").alias("tool_use_id"), F.lit("").alias("output"))))
    use_json = F.to_json(F.array(F.struct(F.lit("tool_use").alias("type"), F.col("use_id").alias("tool_use_id"), F.col("tool_name").alias("name"), F.lit("").alias("input"))))
    df = df.withColumns(
        {"use_id": use_id, "tool_name": F.when(is_part, F.element_at(F.array(*map(F.lit, TOOLS)), (F.col("_k") % 5 + 1).cast("int"))), "payload_len": payload}
    ).withColumn(
        "bytes",
        F.when(F.col("part_type") == "tool_result", F.octet_length(result_json) + F.col("payload_len"))
        .when(F.col("part_type") == "tool_use", F.octet_length(use_json))
        .otherwise(content_bytes(F.col("text")))
        .cast("long"),
    )
    return with_turns(df).drop("_k")


TOOL_MESSAGES = f"""te AS (
    SELECT user_id AS session_id, event_id, ts, value, event_type || ' ' || event_id AS text, event_type AS kind, user_id % 3 AS g,
           (user_id % 3 = 1 AND value < 30) AS low FROM events),
tp AS (
    SELECT *, CASE WHEN kind = 'click' AND NOT (g = 0 OR low) THEN 'tool_use' WHEN kind = 'purchase' AND NOT (g = 0 OR low) THEN 'tool_result' ELSE 'text' END AS part_type FROM te),
tr AS (
    SELECT *, CASE WHEN part_type = 'tool_use' THEN 'assistant' WHEN part_type = 'tool_result' THEN 'tool'
                   WHEN kind = 'signup' OR (kind IN ('view', 'purchase') AND g = 0) OR (kind = 'click' AND (g = 0 OR low)) THEN 'user' ELSE 'assistant' END AS role,
           row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS msg_idx,
           row_number() OVER (PARTITION BY session_id, part_type ORDER BY ts, event_id) AS k FROM tp),
tu AS (
    SELECT *, CASE WHEN part_type <> 'text' THEN 't' || k END AS use_id,
           CASE WHEN part_type <> 'text' THEN [{', '.join(f"'{t}'" for t in TOOLS)}][(k % 5 + 1)::INT] END AS tool_name,
           CASE WHEN part_type = 'tool_result' THEN floor(value * 100) ELSE 0 END::BIGINT AS payload_len FROM tr),
tb AS (
    SELECT session_id, msg_idx::BIGINT AS msg_idx, event_id, role, part_type, use_id, tool_name, text, payload_len, ts, value,
           CASE part_type WHEN 'tool_result' THEN strlen(to_json([{{'type': 'tool_result', 'tool_use_id': use_id, 'output': ''}}])::VARCHAR) + payload_len
                          WHEN 'tool_use' THEN strlen(to_json([{{'type': 'tool_use', 'tool_use_id': use_id, 'name': tool_name, 'input': ''}}])::VARCHAR)
                          ELSE strlen(to_json([{{'type': 'text', 'text': text}}])::VARCHAR) END::BIGINT AS bytes FROM tu),
t AS ({turns_sql('tb')})"""


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluated task per labelled document, with its turns nested as a run store keeps them."""
    i = F.col("doc_id")
    events = F.filter(
        F.array(
            F.when(i % 3 == 0, F.struct(F.lit("observer").alias("type"), F.lit(0).alias("turn_index"), (i % 9 * 100).alias("before_bytes"), (i % 9 * 40).alias("after_bytes"))),
            F.when(i % 5 == 0, F.struct(F.lit("offload").alias("type"), F.lit(0).alias("turn_index"), (i % 7 * 500).alias("before_bytes"), (i % 7 * 60).alias("after_bytes"))),
        ),
        lambda e: e.isNotNull(),
    )
    recalls = F.when(i % 7 == 0, F.array(F.concat(F.lit("r"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    signal = F.element_at(F.array(*map(F.lit, ("conversational", "tool_heavy", "mixed"))), ((i + F.lit(1)) % 3 + 1).cast("int"))
    none = F.array().cast("array<struct<type:string,turn_index:int,before_bytes:bigint,after_bytes:bigint>>")
    turns = F.transform(
        F.sequence(F.lit(0), (i % 4).cast("int")),
        lambda t: F.struct(
            t.alias("turn_index"),
            (i * 37 % 900 + t * 11).cast("long").alias("wall_clock_ms"),
            F.when(t % 2 == 0, signal).otherwise(F.when(i % 2 == 0, F.lit("mixed"))).alias("class_signal"),
            F.when(t == 0, recalls).otherwise(F.array().cast("array<string>")).alias("recall_events"),
            F.when(t == 0, events).otherwise(none).alias("compaction_events"),
        ),
    )
    tokens_in = F.ceil(F.col("n_chars") / 4).cast("long")
    tokens_out = (F.col("n_chars") % 500).cast("long")
    return (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
        .select(
            i.alias("task_id"),
            F.col("lang").alias("bench"),
            F.col("source").alias("config_id"),
            (i % 2).cast("int").alias("seed"),
            F.col("quality").cast("double").alias("score"),
            (1 - F.col("toxic")).cast("double").alias("score_b"),
            tokens_in.alias("input_tokens"),
            tokens_out.alias("output_tokens"),
            F.floor(tokens_in * (i % 4) / 4).cast("long").alias("cache_read"),
            ((tokens_in * 0.75 + tokens_out * 4.5) / 1e6).alias("cost_usd"),
            ((i % 3) * 0.0001).alias("judge_cost_usd"),
            F.when(i % 17 == 0, 1).otherwise(0).cast("long").alias("n_errors"),
            F.element_at(F.array(*map(F.lit, STRATEGIES)), (i % 5 + 1).cast("int")).alias("strategy"),
            ((i * 37 % 1000) / 100).alias("latency_s"),
            turns.alias("turns"),
        )
    )


RUN_RECORDS = f"""r AS (
    SELECT doc_id AS task_id, lang AS bench, source AS config_id, (doc_id % 2)::INT AS seed, quality::DOUBLE AS score, (1 - toxic)::DOUBLE AS score_b,
           ceil(n_chars / 4.0)::BIGINT AS input_tokens, (n_chars % 500)::BIGINT AS output_tokens,
           floor(ceil(n_chars / 4.0) * (doc_id % 4) / 4.0)::BIGINT AS cache_read,
           (ceil(n_chars / 4.0)::DOUBLE * 0.75::DOUBLE + (n_chars % 500) * 4.5::DOUBLE) / 1e6 AS cost_usd,
           (doc_id % 3) * 0.0001::DOUBLE AS judge_cost_usd, CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END::BIGINT AS n_errors,
           [{', '.join(f"'{s}'" for s in STRATEGIES)}][(doc_id % 5 + 1)::INT] AS strategy, (doc_id * 37 % 1000) / 100.0::DOUBLE AS latency_s,
           doc_id % 3 = 0 AS has_obs, doc_id % 5 = 0 AS has_off, doc_id % 7 = 0 AS has_rec,
           (doc_id % 4 + 1)::BIGINT AS n_turns, ['conversational', 'tool_heavy', 'mixed'][((doc_id + 1) % 3 + 1)::INT] AS signal
    FROM labels JOIN documents USING (doc_id))"""
