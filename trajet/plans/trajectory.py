"""Queries over sessions: turns, features, pairing, windows, offload, context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, groups, strategies, windows
from ..sources.derive import MESSAGES, TOOL_MESSAGES, messages, table, tool_messages, turns_sql, with_turns
from .registry import query

BUDGET, OBSERVE = 400, 500
R6 = lambda c: F.round(c, 6)


@query(f"WITH {MESSAGES} SELECT session_id, msg_idx, role, turn_index, step_index FROM ({turns_sql('m')})")
def q_turn_metadata(spark, d):
    return with_turns(messages(spark, d)).select("session_id", "msg_idx", "role", "turn_index", "step_index")


@query("""SELECT conv_id AS session_id, sum(ceil(length(text) / 4.0))::BIGINT AS tokens,
    sum(strlen(to_json([{'type': 'text', 'text': text}])::VARCHAR))::BIGINT AS bytes, count(*)::BIGINT AS n FROM conversations GROUP BY 1""")
def q_message_tokens_bytes(spark, d):
    m = messages(spark, d).withColumn("b", T.content_bytes(F.col("text")))
    return m.groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.sum("b").alias("bytes"), F.count(F.lit(1)).alias("n"))


FEATURES = """
    last AS (SELECT *, max(turn_index) OVER (PARTITION BY session_id) AS last FROM {src}),
    f AS (SELECT session_id, coalesce(max(last) + 1, 0)::BIGINT AS turns_total,
        CASE WHEN max(last) IS NULL THEN 0.0::DOUBLE ELSE count(*) FILTER (part_type = 'tool_use') / (max(last) + 1)::DOUBLE END AS tool_call_density,
        coalesce(avg(bytes) FILTER (part_type = 'tool_result'), 0) AS avg_tool_result_size,
        count(*) FILTER (part_type = 'tool_use' AND coalesce(turn_index, 0) > last - 3) / 3.0::DOUBLE AS recent_tool_density,
        count(*) FILTER (role = 'user') / count(*)::DOUBLE AS user_turn_ratio, false AS multimodal_flag, ceil(sum(bytes) / 4.0)::BIGINT AS cumulative_tokens
      FROM last GROUP BY 1),
    c AS (SELECT *, CASE WHEN turns_total < 2 THEN 'mixed'
        WHEN (1 - tool_call_density) * user_turn_ratio > 0.6::DOUBLE AND tool_call_density * 0.5::DOUBLE + recent_tool_density * 0.5::DOUBLE < 0.3::DOUBLE THEN 'conversational'
        WHEN tool_call_density * 0.5::DOUBLE + recent_tool_density * 0.5::DOUBLE > 0.5::DOUBLE THEN 'tool_heavy' ELSE 'mixed' END AS class FROM f)"""
CONV_PARTS = f"""{MESSAGES}, p AS (SELECT *, 'text' AS part_type, strlen(to_json([{{'type': 'text', 'text': text}}])::VARCHAR) AS bytes FROM ({turns_sql('m')}))"""
SHOW = """SELECT session_id, turns_total, round(tool_call_density, 6) AS tool_call_density, round(avg_tool_result_size, 6) AS avg_tool_result_size,
    round(recent_tool_density, 6) AS recent_tool_density, round(user_turn_ratio, 6) AS user_turn_ratio, multimodal_flag, cumulative_tokens, class FROM c"""


def conversation_parts(spark, d):
    # sizes first: the texts stay out of the shuffle
    sized = messages(spark, d).withColumns({"part_type": F.lit("text"), "bytes": T.content_bytes(F.col("text"))}).drop("text")
    return with_turns(sized)


def shown(feats):
    rounded = {c: R6(F.col(c)) for c in ("tool_call_density", "avg_tool_result_size", "recent_tool_density", "user_turn_ratio")}
    return classify.classify(feats).withColumns(rounded)


@query(f"WITH {CONV_PARTS}, {FEATURES.format(src='p')} {SHOW}")
def q_features_classify(spark, d):
    return shown(classify.features(conversation_parts(spark, d)))


@query(f"WITH {TOOL_MESSAGES}, {FEATURES.format(src='t')} {SHOW}")
def q_tool_features(spark, d):
    return shown(classify.features(tool_messages(spark, d)))


HYSTERESIS = f"""{TOOL_MESSAGES},
    w AS (SELECT session_id, turn_index,
        count(*) FILTER (part_type = 'tool_use') OVER u AS uses, count(*) FILTER (role = 'user') OVER u AS users, count(*) OVER u AS n,
        count(*) FILTER (part_type = 'tool_use') OVER (PARTITION BY session_id ORDER BY turn_index RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent,
        row_number() OVER (PARTITION BY session_id, turn_index ORDER BY msg_idx DESC) AS rn
        FROM t WINDOW u AS (PARTITION BY session_id ORDER BY msg_idx)),
    rc AS (SELECT session_id, turn_index, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) AS i,
        CASE WHEN turn_index + 1 < 2 THEN 'mixed'
             WHEN (1 - uses / (turn_index + 1)::DOUBLE) * (users / n::DOUBLE) > 0.6::DOUBLE AND uses / (turn_index + 1)::DOUBLE * 0.5::DOUBLE + recent / 3.0::DOUBLE * 0.5::DOUBLE < 0.3::DOUBLE THEN 'conversational'
             WHEN uses / (turn_index + 1)::DOUBLE * 0.5::DOUBLE + recent / 3.0::DOUBLE * 0.5::DOUBLE > 0.5::DOUBLE THEN 'tool_heavy' ELSE 'mixed' END AS raw_class FROM w WHERE rn = 1),
    h AS (SELECT session_id, turn_index, i, raw_class, raw_class AS class, NULL::VARCHAR AS pending FROM rc WHERE i = 1
        UNION ALL SELECT rc.session_id, rc.turn_index, rc.i, rc.raw_class,
            CASE WHEN rc.raw_class = h.class OR rc.raw_class = h.pending THEN rc.raw_class ELSE h.class END,
            CASE WHEN rc.raw_class = h.class OR rc.raw_class = h.pending THEN NULL ELSE rc.raw_class END
        FROM h JOIN rc ON rc.session_id = h.session_id AND rc.i = h.i + 1)"""


@query(f"WITH RECURSIVE {HYSTERESIS} SELECT session_id, turn_index, raw_class, class FROM h")
def q_hysteresis(spark, d):
    return classify.hysteresis(classify.prefix_classes(tool_messages(spark, d)))


@query(f"WITH {TOOL_MESSAGES}, {FEATURES.format(src='t')} SELECT session_id, class, class IN ('conversational', 'mixed') AS run_observer, class IN ('tool_heavy', 'mixed') AS run_offloader FROM c")
def q_dispatch_plan(spark, d):
    plan = classify.dispatch(classify.classify(classify.features(tool_messages(spark, d))))
    return plan.select("session_id", "class", "run_observer", "run_offloader")


PAIRS = f"""{TOOL_MESSAGES},
    uses AS (SELECT session_id, use_id, msg_idx AS use_idx, coalesce(turn_index, 0) AS turn_index, tool_name FROM t WHERE part_type = 'tool_use'
             QUALIFY row_number() OVER (PARTITION BY session_id, use_id ORDER BY msg_idx DESC) = 1),
    results AS (SELECT session_id, use_id, msg_idx AS result_idx, bytes AS result_bytes FROM t WHERE part_type = 'tool_result'),
    pairs AS (SELECT coalesce(uses.session_id, results.session_id) AS session_id, coalesce(uses.use_id, results.use_id) AS use_id, use_idx, turn_index, tool_name, result_idx, result_bytes,
        CASE WHEN use_idx IS NULL THEN 'orphan' WHEN result_idx IS NULL THEN 'inflight' ELSE 'group' END AS kind,
        CASE WHEN use_idx IS NOT NULL THEN substr(sha256(uses.use_id || ':' || turn_index), 1, 16) END AS group_id
        FROM uses FULL JOIN results ON uses.session_id = results.session_id AND uses.use_id = results.use_id)"""


@query(f"WITH {PAIRS} SELECT session_id, group_id, use_id, use_idx, result_idx, turn_index, result_bytes FROM pairs WHERE kind = 'group'")
def q_atomic_groups(spark, d):
    p = groups.pairs(tool_messages(spark, d)).filter("kind = 'group'")
    return p.select("session_id", "group_id", "use_id", "use_idx", "result_idx", "turn_index", "result_bytes")


@query(f"WITH {PAIRS} SELECT session_id, group_id, use_idx, turn_index FROM pairs WHERE kind = 'inflight'")
def q_inflight(spark, d):
    return groups.pairs(tool_messages(spark, d)).filter("kind = 'inflight'").select("session_id", "group_id", "use_idx", "turn_index")


@query(f"WITH {PAIRS} SELECT session_id, use_id, result_idx FROM pairs WHERE kind = 'orphan'")
def q_orphans(spark, d):
    return groups.pairs(tool_messages(spark, d)).filter("kind = 'orphan'").select("session_id", "use_id", "result_idx")


@query(f"""WITH {TOOL_MESSAGES} SELECT session_id, use_id, use_idx, reasoning_idx FROM (
    SELECT session_id, use_id, part_type, msg_idx AS use_idx,
        CASE WHEN lag(role) OVER o = 'assistant' AND lag(part_type) OVER o = 'text' THEN lag(msg_idx) OVER o END AS reasoning_idx
    FROM t WINDOW o AS (PARTITION BY session_id ORDER BY msg_idx)) WHERE part_type = 'tool_use'""")
def q_reasoning_attach(spark, d):
    return groups.reasoning(tool_messages(spark, d))


KEPT = "SELECT session_id, msg_idx, role, tokens FROM"


@query(f"""WITH {MESSAGES} {KEPT} (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY session_id ORDER BY msg_idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM m)
    WHERE t < {BUDGET}""")
def q_tail_budget(spark, d):
    return windows.tail_budget(messages(spark, d), BUDGET).drop("text")


@query(f"""WITH {MESSAGES} {KEPT} (SELECT *, sum(tokens) OVER w AS t, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY session_id ORDER BY msg_idx DESC))
    WHERE t <= {BUDGET} OR rn = 1""")
def q_tail_clip(spark, d):
    return windows.tail_clip(messages(spark, d), BUDGET).drop("text")


NAIVE = f"""nv AS (SELECT *, role = 'system' OR sum(CASE WHEN role = 'system' THEN 0 ELSE tokens END) OVER (PARTITION BY session_id ORDER BY msg_idx DESC)
        <= greatest(0, {BUDGET} - sum(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY session_id)) AS stays FROM m),
    naive AS (SELECT session_id, msg_idx, role, text, tokens FROM nv WHERE stays
        UNION ALL SELECT session_id, -1, 'user', '<<<earlier history truncated: ' || n || ' turns dropped>>>', ceil(length('<<<earlier history truncated: ' || n || ' turns dropped>>>') / 4.0)::BIGINT
        FROM (SELECT session_id, count(*) AS n FROM nv WHERE NOT stays GROUP BY 1))"""


@query(f"WITH {MESSAGES}, {NAIVE} SELECT * FROM naive")
def q_naive_truncation(spark, d):
    return windows.naive_truncation(messages(spark, d), BUDGET)


@query(f"""WITH RECURSIVE {PAIRS},
    seed AS (SELECT session_id, (max(msg_idx) * 3 // 4)::BIGINT AS start FROM t GROUP BY 1),
    x(session_id, start, k) AS (SELECT session_id, start, 0 FROM seed
        UNION ALL SELECT x.session_id, min(p.use_idx), any_value(x.k) + 1 FROM x JOIN pairs p ON p.session_id = x.session_id AND p.kind = 'group' AND p.result_idx >= x.start AND p.use_idx < x.start GROUP BY x.session_id)
    SELECT session_id, min(start) AS start FROM x GROUP BY 1""")
def q_pair_expansion(spark, d):
    t = tool_messages(spark, d)
    seed = t.groupBy("session_id").agg(F.expr("max(msg_idx) * 3 div 4").alias("start"))
    return windows.pair_start(seed, groups.pairs(t).filter("kind = 'group'"))


@query(f"""WITH {TOOL_MESSAGES}, o AS (SELECT session_id, max(turn_index) // 2 AS wm FROM t WHERE session_id % 4 <> 0 GROUP BY 1)
    SELECT t.session_id, msg_idx, turn_index FROM t LEFT JOIN o USING (session_id) WHERE turn_index IS NULL OR turn_index > coalesce(wm, -1)""")
def q_watermark_filter(spark, d):
    t = tool_messages(spark, d)
    seen = t.filter("session_id % 4 <> 0").groupBy("session_id").agg(F.expr("max(turn_index) div 2").alias("last_observed_turn"))
    return windows.watermark(t.select("session_id", "msg_idx", "turn_index"), seen)


OFFLOAD = f"""{PAIRS},
    g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY result_idx) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM pairs WHERE kind = 'group'),
    d AS (SELECT session_id, i, 0::BIGINT AS kept_before, (n - i >= 2 AND (result_bytes > {groups.T_SIZE} OR result_bytes > {groups.T_CUM})) AS offloaded, result_bytes FROM g WHERE i = 1
        UNION ALL SELECT g.session_id, g.i, d.kept_before + CASE WHEN d.offloaded THEN 0 ELSE d.result_bytes END,
            g.n - g.i >= 2 AND (g.result_bytes > {groups.T_SIZE} OR d.kept_before + CASE WHEN d.offloaded THEN 0 ELSE d.result_bytes END + g.result_bytes > {groups.T_CUM}), g.result_bytes
        FROM d JOIN g ON g.session_id = d.session_id AND g.i = d.i + 1),
    od AS (SELECT g.session_id, result_idx, group_id, use_id, tool_name, g.result_bytes, turn_index, offloaded, kept_before FROM g JOIN d ON g.session_id = d.session_id AND g.i = d.i),
    pt AS (SELECT session_id, group_id AS recall_id, tool_name, result_bytes AS original_size_bytes, turn_index,
        '[Offloaded #' || group_id || ' tool=' || tool_name || ' size=' || result_bytes || 'B — summary: recall_tool_summary(' || group_id || '); raw: recall_tool_full(' || group_id || ')]' AS stub FROM od WHERE offloaded)"""


@query(f"WITH RECURSIVE {OFFLOAD} SELECT * FROM od")
def q_offload_decisions(spark, d):
    return groups.offload(groups.pairs(tool_messages(spark, d)).filter("kind = 'group'"))


@query(f"WITH RECURSIVE {OFFLOAD} SELECT * FROM pt")
def q_pointers(spark, d):
    return groups.pointers(q_offload_decisions(spark, d))


@query(f"""WITH RECURSIVE {OFFLOAD}, rq AS (SELECT session_id, group_id AS recall_id FROM g WHERE use_idx % 2 = 0)
    SELECT rq.session_id, rq.recall_id, pt.recall_id IS NOT NULL AS hit,
        CASE WHEN pt.recall_id IS NULL THEN 'unknown recall_id: ' || rq.recall_id ELSE 'summary of ' || original_size_bytes || ' bytes' END AS answer
    FROM rq LEFT JOIN pt ON pt.session_id = rq.session_id AND pt.recall_id = rq.recall_id""")
def q_recall_lookup(spark, d):
    pairs = groups.pairs(tool_messages(spark, d)).filter("kind = 'group'")
    asked = pairs.filter("use_idx % 2 = 0").select("session_id", F.col("group_id").alias("recall_id"))
    return groups.recall(asked, groups.pointers(groups.offload(pairs)))


TIER = f"""{MESSAGES}, mt AS ({turns_sql('m')}),
    tier1 AS (SELECT session_id, count(*) FILTER (role = 'system') AS n_system, count(*) FILTER (role = 'user') AS n_user,
        min(msg_idx) FILTER (role = 'system') AS system_idx, min(msg_idx) FILTER (role = 'user') AS first_user_idx FROM m GROUP BY 1),
    rest AS (SELECT mt.*, coalesce(sum(tokens) OVER (PARTITION BY session_id ORDER BY msg_idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken
        FROM mt JOIN tier1 USING (session_id) WHERE n_system = 1 AND n_user > 0 AND msg_idx <> system_idx AND msg_idx <> first_user_idx),
    tz AS (SELECT m.session_id, m.msg_idx, CASE WHEN n_system <> 1 THEN 'not exactly one system message' WHEN n_user = 0 THEN 'no user message' END AS rejected_reason,
        CASE WHEN n_system <> 1 OR n_user = 0 THEN 'passthrough' WHEN m.msg_idx = system_idx THEN 'system' WHEN m.msg_idx = first_user_idx THEN 'first_user'
             WHEN taken < {BUDGET} THEN 'recent' ELSE 'dropped' END AS tier
        FROM m JOIN tier1 USING (session_id) LEFT JOIN rest ON rest.session_id = m.session_id AND rest.msg_idx = m.msg_idx)"""


@query(f"WITH {TIER} SELECT session_id, msg_idx, tier, rejected_reason FROM tz")
def q_tierize(spark, d):
    return strategies.tierize(messages(spark, d), BUDGET).select("session_id", "msg_idx", "tier", "rejected_reason")


@query(f"""WITH {TIER} SELECT session_id, msg_idx, tier, (row_number() OVER (PARTITION BY session_id ORDER BY CASE tier WHEN 'system' THEN 0 WHEN 'first_user' THEN 1 ELSE 3 END, msg_idx) - 1)::BIGINT AS position
    FROM (SELECT session_id, msg_idx, tier FROM tz WHERE tier IN ('system', 'first_user', 'recent')
          UNION ALL SELECT session_id, -1 AS msg_idx, 'note' AS tier FROM tz GROUP BY 1 HAVING count(*) FILTER (tier = 'dropped') > 0)
    WHERE true""".replace("ELSE 3 END", "WHEN 'note' THEN 2 ELSE 3 END"))
def q_assemble_context(spark, d):
    return strategies.assemble(strategies.tierize(messages(spark, d), BUDGET)).select("session_id", "msg_idx", "tier", "position")


@query(f"""WITH {TIER}, ft AS (SELECT session_id, sum(tokens) AS total FROM m GROUP BY 1)
    SELECT session_id, any_value(total)::BIGINT AS tokens_before, sum(CASE WHEN tier <> 'dropped' THEN tokens ELSE 0 END)::BIGINT AS tokens_after,
        count(*) FILTER (tier = 'dropped')::BIGINT AS n_dropped, any_value(total) >= {OBSERVE} AND any_value(rejected_reason) IS NULL AS observer_fires, max(rejected_reason) AS rejected_reason
    FROM tz JOIN m USING (session_id, msg_idx) JOIN ft USING (session_id) GROUP BY 1""")
def q_compact(spark, d):
    return strategies.compact(messages(spark, d), BUDGET, OBSERVE)


@query(f"""WITH {MESSAGES}, p AS (SELECT session_id, msg_idx, sha256(string_agg(role || ':' || text, chr(10)) OVER (PARTITION BY session_id ORDER BY msg_idx)) AS h,
        sha256(first_value(role || ':' || text) OVER (PARTITION BY session_id ORDER BY msg_idx)) AS first_hash FROM m)
    SELECT session_id, msg_idx, h AS prefix_hash, first_hash = lag(first_hash) OVER (PARTITION BY session_id ORDER BY msg_idx) AS stable FROM p""")
def q_prefix_invariance(spark, d):
    order = Window.partitionBy("session_id").orderBy("msg_idx")
    line = F.concat("role", F.lit(":"), "text")
    prefix = F.sha2(F.array_join(F.collect_list(line).over(order.rowsBetween(Window.unboundedPreceding, 0)), "\n"), 256)
    m = messages(spark, d).select("session_id", "msg_idx", prefix.alias("prefix_hash"), F.sha2(F.first(line).over(order), 256).alias("_h"))
    return m.select("session_id", "msg_idx", "prefix_hash", (F.col("_h") == F.lag("_h").over(order)).alias("stable"))


ROLL = """rn AS (SELECT *, ((row_number() OVER (PARTITION BY session_id ORDER BY msg_idx) - 1) // 2)::BIGINT AS chunk FROM m),
    rc AS (SELECT *, max(chunk) OVER (PARTITION BY session_id) AS last FROM rn)"""


@query(f"WITH {MESSAGES}, {ROLL} SELECT session_id, chunk, count(*)::BIGINT AS turns, sum(tokens)::BIGINT AS tokens, any_value(chunk > last - 2) AS verbatim FROM rc GROUP BY 1, 2")
def q_rolling_chunks(spark, d):
    c = strategies.chunks(messages(spark, d), size=2, keep=2)
    return c.groupBy("session_id", "chunk").agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"), F.any_value("verbatim").alias("verbatim"))


TYPE = f"""s AS (SELECT session_id, coalesce(sum(tokens) FILTER (role = 'system'), 0) AS sys, coalesce(sum(tokens) FILTER (role = 'user'), 0) AS usr,
        coalesce(sum(tokens) FILTER (role = 'assistant'), 0) AS ast FROM m GROUP BY 1),
    k AS (SELECT session_id, sum(tokens) AS kept FROM (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY msg_idx DESC) AS run FROM m WHERE role = 'user') WHERE run <= {int(0.6 * BUDGET)} GROUP BY 1),
    b AS (SELECT session_id, sys::BIGINT AS system_used, greatest(0, {BUDGET} - sys)::BIGINT AS after_system,
        (CASE WHEN usr <= greatest(0, {BUDGET} - sys) THEN usr ELSE coalesce(kept, 0) END)::BIGINT AS user_used,
        CASE WHEN usr <= greatest(0, {BUDGET} - sys) THEN 'all_verbatim' ELSE 'fallback_recent_verbatim_plus_1line' END AS user_policy, ast::BIGINT AS assistant_total FROM s LEFT JOIN k USING (session_id))"""


@query(f"""WITH {MESSAGES}, {TYPE} SELECT session_id, system_used, after_system, user_used, user_policy, assistant_total, greatest(0, after_system - user_used)::BIGINT AS after_user,
    CASE WHEN assistant_total = 0 THEN 'absent' WHEN assistant_total <= greatest(0, after_system - user_used) THEN 'verbatim_under_residual' ELSE 'rolling_over_residual' END AS assistant_policy FROM b""")
def q_type_aware_budget(spark, d):
    return strategies.type_budget(messages(spark, d), BUDGET)


@query(f"""WITH {MESSAGES} SELECT session_id, msg_idx, role, rn <= 3 AS verbatim, CASE WHEN rn <= 3 THEN text ELSE '[' || role || ' stub: chars=' || length(text) || ']' END AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id, role ORDER BY msg_idx DESC) AS rn FROM m)""")
def q_keep_last3(spark, d):
    return strategies.keep_last(messages(spark, d), 3).select("session_id", "msg_idx", "role", "verbatim", "text")


@query(f"""WITH {MESSAGES} SELECT session_id, string_agg(role || ': ' || text, chr(10) ORDER BY msg_idx) AS transcript, count(*)::BIGINT AS n FROM m GROUP BY 1""")
def q_session_flatten(spark, d):
    return strategies.flatten(messages(spark, d))


@query(f"""WITH {MESSAGES} SELECT session_id, 0::BIGINT AS turn, '[session ' || session_id || ']' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY msg_idx) AS text FROM m GROUP BY 1
    UNION ALL SELECT session_id, 1, 'What did the user last say?' FROM m GROUP BY 1""")
def q_session_replay(spark, d):
    flat = strategies.flatten(messages(spark, d))
    head = flat.select("session_id", F.lit(0).cast("long").alias("turn"), F.concat(F.lit("[session "), F.col("session_id").cast("string"), F.lit("]\n"), "transcript").alias("text"))
    return head.unionByName(flat.select("session_id", F.lit(1).cast("long").alias("turn"), F.lit("What did the user last say?").alias("text")))


@query(f"""WITH {TOOL_MESSAGES} SELECT session_id, count(*)::BIGINT AS n_messages, count(*) FILTER (part_type = 'tool_use')::BIGINT AS n_calls, count(*) FILTER (part_type = 'tool_result')::BIGINT AS n_results,
    round(sum(bytes) / 4.0, 0)::BIGINT AS approx_tokens, arg_max(role, msg_idx) AS last_role, coalesce(array_to_string(list_sort(list_distinct(list(tool_name) FILTER (tool_name IS NOT NULL))), ','), '') AS tools FROM t GROUP BY 1""")
def q_session_stats(spark, d):
    t = tool_messages(spark, d)
    return t.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.col("part_type") == "tool_use").alias("n_calls"),
        F.count_if(F.col("part_type") == "tool_result").alias("n_results"),
        F.round(F.sum("bytes") / 4).cast("long").alias("approx_tokens"),
        F.max_by("role", "msg_idx").alias("last_role"),
        F.array_join(F.array_sort(F.collect_set("tool_name")), ",").alias("tools"),
    )


@query(f"WITH {TOOL_MESSAGES} SELECT session_id, msg_idx, role, text FROM t WHERE part_type = 'text' AND length(text) > 0")
def q_text_messages(spark, d):
    return tool_messages(spark, d).filter("part_type = 'text' and length(text) > 0").select("session_id", "msg_idx", "role", "text")


@query("SELECT conv_id AS session_id, turn AS msg_idx, text FROM conversations WHERE role = 'user'")
def q_user_turns(spark, d):
    return messages(spark, d).filter("role = 'user'").select("session_id", "msg_idx", "text")


@query(f"""WITH {TOOL_MESSAGES} SELECT session_id, msg_idx, CASE role WHEN 'tool' THEN 'user' ELSE role END AS chat_role,
    CASE part_type WHEN 'tool_use' THEN '[tool call: ' || tool_name || ']' WHEN 'tool_result' THEN '[tool result: ' || tool_name || ']' ELSE text END AS content FROM t""")
def q_chat_projection(spark, d):
    content = F.when(F.col("part_type") == "tool_use", F.concat(F.lit("[tool call: "), "tool_name", F.lit("]"))).when(
        F.col("part_type") == "tool_result", F.concat(F.lit("[tool result: "), "tool_name", F.lit("]"))
    )
    role = F.when(F.col("role") == "tool", "user").otherwise(F.col("role"))
    return tool_messages(spark, d).select("session_id", "msg_idx", role.alias("chat_role"), F.coalesce(content, "text").alias("content"))


@query(f"WITH {MESSAGES} SELECT session_id, arg_max(text, msg_idx) AS last_user_text, max(msg_idx) AS last_user_idx FROM m WHERE role = 'user' GROUP BY 1")
def q_last_user(spark, d):
    u = messages(spark, d).filter("role = 'user'").groupBy("session_id")
    return u.agg(F.max_by("text", "msg_idx").alias("last_user_text"), F.max("msg_idx").alias("last_user_idx"))


@query(f"""WITH {MESSAGES}, mt AS ({turns_sql('m')}) SELECT session_id, msg_idx, last_value(turn_index IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY msg_idx) AS source_turn FROM mt""")
def q_source_turn(spark, d):
    order = Window.partitionBy("session_id").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, 0)
    return with_turns(messages(spark, d)).select("session_id", "msg_idx", F.last("turn_index", ignorenulls=True).over(order).alias("source_turn"))


@query(f"""WITH {MESSAGES}, s AS (SELECT session_id, sum(tokens)::BIGINT AS tokens, count(*) AS n FROM m GROUP BY 1)
    SELECT session_id, tokens, CASE WHEN tokens < {OBSERVE} THEN 'below_threshold' ELSE 'no_caller' END AS observer_skip, tokens >= {2 * OBSERVE} AS reflects, tokens > 1.2 * {OBSERVE} AS blocks_after,
        isfinite(tokens / n::DOUBLE) AS finite_mean FROM s""")
def q_gates(spark, d):
    s = messages(spark, d).groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    mean = F.col("tokens") / F.col("n")
    return s.select(
        "session_id", "tokens",
        F.when(F.col("tokens") < OBSERVE, "below_threshold").otherwise("no_caller").alias("observer_skip"),
        (F.col("tokens") >= 2 * OBSERVE).alias("reflects"),
        (F.col("tokens") > 1.2 * OBSERVE).alias("blocks_after"),
        (mean.isNotNull() & ~F.isnan(mean) & (F.abs(mean) < float("inf"))).alias("finite_mean"),
    )


@query("""SELECT user_id AS session_id, event_id, ts - lag(ts) OVER w > INTERVAL 1 HOUR AS evicted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_idle_eviction(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    idle = F.col("ts") - F.lag("ts").over(order) > F.expr("interval 1 hour")
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", idle.alias("evicted"))


@query(f"""WITH {MESSAGES}, {NAIVE}, {ROLL}, {TYPE},
    roll AS (SELECT session_id, sum(CASE WHEN chunk > last - 2 THEN tokens ELSE 0 END) + 10 * count(DISTINCT chunk) FILTER (chunk <= last - 2) AS t FROM rc GROUP BY 1),
    full_ AS (SELECT session_id, sum(tokens) AS t FROM m GROUP BY 1),
    ty AS (SELECT session_id, system_used + user_used + least(assistant_total, greatest(0, after_system - user_used)) AS t FROM b)
    SELECT strategy, count(*)::BIGINT AS sessions, sum(t)::BIGINT AS compacted_tokens FROM (
        SELECT 'full_context' AS strategy, t FROM full_ UNION ALL SELECT 'naive_truncation', sum(tokens) FROM naive GROUP BY session_id
        UNION ALL SELECT 'rolling_summary', t FROM roll UNION ALL SELECT 'type_aware', t FROM ty) GROUP BY 1""")
def q_strategy_compare(spark, d):
    return strategies.compare(messages(spark, d), BUDGET)


OBS = """ob AS (SELECT session_id, msg_idx AS seq, '- 2024-01-' || lpad((msg_idx % 28 + 1)::VARCHAR, 2, '0') || ' (' || ['high', 'med', 'low'][(msg_idx % 3 + 1)::INT] || ') ' || text AS line FROM m WHERE role = 'user')"""


def observation_lines(spark, d):
    u = messages(spark, d).filter("role = 'user'")
    day = F.lpad((F.col("msg_idx") % 28 + 1).cast("string"), 2, "0")
    conf = F.element_at(F.array(F.lit("high"), F.lit("med"), F.lit("low")), (F.col("msg_idx") % 3 + 1).cast("int"))
    line = F.concat(F.lit("- 2024-01-"), day, F.lit(" ("), conf, F.lit(") "), "text")
    return u.select("session_id", F.col("msg_idx").alias("seq"), line.alias("line"))


WINDOW_SQL = "SELECT *, sum(ceil(length(line) / 4.0)) OVER (PARTITION BY session_id ORDER BY seq DESC) AS t FROM ob"


@query(f"WITH {MESSAGES}, {OBS} SELECT session_id, string_agg(line, chr(10) ORDER BY seq) AS previous, count(*)::BIGINT AS n_lines FROM ({WINDOW_SQL}) WHERE t <= 60 GROUP BY 1")
def q_prev_obs_tail(spark, d):
    return strategies.line_tail(observation_lines(spark, d), 60)


@query(f"""WITH {MESSAGES}, {OBS},
    prev AS (SELECT session_id, string_agg(line, chr(10) ORDER BY seq) AS previous FROM ({WINDOW_SQL}) WHERE t <= 60 GROUP BY 1),
    msgs AS (SELECT session_id, string_agg(role || ': ' || to_json([{{'type': 'text', 'text': text}}])::VARCHAR, chr(10) ORDER BY msg_idx) AS recent, arg_max(text, msg_idx) FILTER (role = 'user') AS asked FROM m GROUP BY 1)
    SELECT session_id, 'Recent messages:' || chr(10) || recent || chr(10) || chr(10) || 'Current user query: ' || coalesce(asked, '') || chr(10) || chr(10) || 'Previous observations:' || chr(10) || coalesce(previous, '') AS prompt
    FROM msgs LEFT JOIN prev USING (session_id)""")
def q_observer_prompt(spark, d):
    return strategies.observer_prompt(messages(spark, d), strategies.line_tail(observation_lines(spark, d), 60))


@query("""SELECT user_id AS session_id, count(*)::BIGINT AS events_before_error FROM (
    SELECT *, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stopped FROM events) WHERE NOT stopped GROUP BY 1""")
def q_turns_until_error(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    stopped = F.bool_or(F.col("event_type") == "error").over(order)
    e = table(spark, d, "events").select("user_id", stopped.alias("stopped")).filter("not stopped")
    return e.groupBy(F.col("user_id").alias("session_id")).agg(F.count(F.lit(1)).alias("events_before_error"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS started, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def q_ext_session_window(spark, d):
    """Extension: idle sessions by the five-minute constant."""
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("started"), "n")
