"""Queries over state. Those without SQL are held against small brute-force versions in the tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import convert, fixtures, pages
from ..sources.derive import TOOLS, table, tool_messages
from ..streaming import registries, state
from .registry import query


@query()
def q_html_extract(spark, d):
    p = table(spark, d, "pages").select("page_id", pages.page_text("html").alias("x"))
    return p.select("page_id", "x.title", "x.text")


@query()
def q_rate_limiter(spark, d):
    """Calls in units of hours, so that the limit binds on this data: 30 calls in 300 hours."""
    calls = table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", (F.col("ts").cast("timestamp").cast("double") / 3600).cast("timestamp").alias("ts"))
    return state.rate_limited(calls)


@query()
def q_fixture_replay(spark, d):
    calls = tool_messages(spark, d).filter("part_type = 'tool_use'").select("session_id", F.col("msg_idx").alias("seq"), "tool_name", F.format_string('{"q":%d}', F.col("msg_idx") % 7).alias("args"))
    rows = [(t, "exact", '{"q":3}', 0, f"{t} three") for t in TOOLS] + [(t, "first", None, i, f"{t} {i}") for t in TOOLS[:3] for i in range(2)]
    return fixtures.replay(calls, spark.createDataFrame(rows, "tool_name string, kind string, args string, slot int, output string"))


@query()
def q_message_roundtrip(spark, d):
    t = tool_messages(spark, d)
    kind = F.when(F.col("part_type") == "tool_use", "tool-call").when(F.col("part_type") == "tool_result", "tool-result").otherwise("text")
    part = F.struct(kind.alias("type"), F.col("text").alias("text"), F.col("use_id").alias("id"), F.col("tool_name").alias("name"))
    sdk = t.select("session_id", "msg_idx", "role", F.array(part).alias("content"))
    back = convert.to_sdk(convert.to_core(sdk))
    return back.select("session_id", "msg_idx", "role", F.to_json("content").alias("content"))


PADS = """pa AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, CASE WHEN event_type IN ('click', 'purchase') THEN 'put' ELSE 'recall' END AS kind, 'g' || event_id % 5 AS group_id,
        CASE WHEN event_type IN ('click', 'purchase') THEN event_type || ' ' || event_id END AS content FROM events),
    ps AS (SELECT *, coalesce(sum((epoch_ms(ts) - epoch_ms(before) > 3600000)::INT) OVER (PARTITION BY session_id ORDER BY seq), 0) AS stretch FROM (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM pa))"""


def pad_accesses(spark, d):
    """Clicks and purchases put their result under one of five groups, other events recall one."""
    puts = F.col("event_type").isin("click", "purchase")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    content = F.when(puts, F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))
    group = F.concat(F.lit("g"), (F.col("event_id") % 5).cast("string"))
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), seq.cast("long").alias("seq"), "ts", F.when(puts, "put").otherwise("recall").alias("kind"), group.alias("group_id"), content.alias("content"))


@query(f"""WITH {PADS}, h AS (SELECT *, last_value(content IGNORE NULLS) OVER (PARTITION BY session_id, stretch, group_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM ps)
    SELECT session_id, seq, kind, group_id, CASE WHEN kind = 'put' THEN 'kept' WHEN held IS NOT NULL THEN 'found' ELSE 'unknown' END AS answer, CASE WHEN kind = 'recall' THEN held END AS content,
        sum((kind = 'put' AND held IS NULL)::INT) OVER (PARTITION BY session_id, stretch ORDER BY seq)::BIGINT AS entries FROM h""")
def q_scratchpad_answers(spark, d):
    return registries.scratchpad_answers(pad_accesses(spark, d))


@query(f"""WITH {PADS}, o AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS place, CASE WHEN seq % 3 > 0 THEN seq // 3 END AS turn_index, content FROM pa)
    SELECT session_id, seq, coalesce(array_to_string(list(content) FILTER (content IS NOT NULL) OVER (PARTITION BY session_id ORDER BY seq), '; '), '') AS statements,
        greatest(coalesce(max(turn_index) OVER (PARTITION BY session_id ORDER BY seq), -1), -1)::BIGINT AS last_observed_turn FROM o""")
def q_observations_so_far(spark, d):
    rows = pad_accesses(spark, d).select("session_id", "seq", F.when(F.col("seq") % 3 > 0, F.expr("seq div 3")).alias("turn_index"), F.col("content").alias("statement"))
    return registries.observations_so_far(rows).select("session_id", "seq", F.array_join("observations", "; ").alias("statements"), "last_observed_turn")
