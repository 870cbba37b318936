"""Queries over task corpora, tool palettes, span trees and run checks, on rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpora as C
from ..operators import evaluation as E
from ..operators import traces
from ..sources.derive import MESSAGES, RUN_RECORDS, TOOL_MESSAGES, messages, run_records, table, tool_messages
from .registry import query

NOTE = "Older results can be recalled."


@query(f"WITH {RUN_RECORDS} SELECT concat_ws('/', bench, config_id, seed) AS session_id, count(*)::BIGINT AS traces, count(*)::BIGINT AS root_traces, 0::BIGINT AS nested_traces, sum(n_turns)::BIGINT AS turn_spans, 0::BIGINT AS tool_spans FROM r GROUP BY 1")
def q_span_hierarchy(spark, d):
    return traces.hierarchy(traces.spans_of(run_records(spark, d)))


@query(f"""WITH {RUN_RECORDS}, c AS (SELECT bench, config_id, seed, count(*) AS n FROM r GROUP BY 1, 2, 3), s AS (SELECT *, CASE WHEN n % 3 = 0 THEN 0 ELSE n END AS done, CASE WHEN n % 2 = 0 THEN 'partial' ELSE 'complete' END AS status, n % 5 = 0 AS gone, concat_ws('/', bench, config_id, seed) AS path FROM c)
    SELECT 'warn' AS severity, path, 'summary missing' AS "check" FROM s WHERE gone UNION ALL SELECT 'error', path, 'nothing completed' FROM s WHERE NOT gone AND done = 0 UNION ALL SELECT 'warn', path, 'partial' FROM s WHERE NOT gone AND status = 'partial'""")
def q_summary_issues(spark, d):
    c = run_records(spark, d).groupBy(*E.CELL).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    done = c.filter(n % 5 != 0).select(*E.CELL, F.when(n % 3 == 0, 0).otherwise(n).alias("n_completed"), F.when(n % 2 == 0, "partial").otherwise("complete").alias("status"))
    return E.summary_issues(c, done)


@query(f"""WITH {RUN_RECORDS}, j AS (SELECT bench, task_id, CASE task_id % 5 WHEN 0 THEN NULL WHEN 1 THEN -1 WHEN 2 THEN 'nan'::DOUBLE ELSE 0.5 END AS cost, CASE task_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'judge-stub' WHEN 3 THEN 'because' END AS said FROM r)
    SELECT bench, task_id, 'warn' AS severity, 'no judge evidence' AS "check" FROM j WHERE bench IN ('en', 'de') AND (cost IS NULL OR isnan(cost) OR cost < 0) AND coalesce(said, '') IN ('', 'judge-stub')""")
def q_judge_issues(spark, d):
    i = F.col("task_id")
    cost = F.when(i % 5 == 0, None).when(i % 5 == 1, -1.0).when(i % 5 == 2, float("nan")).otherwise(0.5)
    said = F.when(i % 4 == 0, "").when(i % 4 == 1, "judge-stub").when(i % 4 == 3, "because")
    return E.judge_issues(run_records(spark, d).select("bench", "task_id", cost.alias("judge_cost_usd"), said.alias("judge_explanation")), ["en", "de"])


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || '|[Image attachment: /i/' || doc_id || '.png; alt=' || lang || ']' WHEN 2 THEN '[Image attachment: /i/' || doc_id || '.png]|[File attachment: /f/' || doc_id || '.pdf]' ELSE '' END AS shown FROM documents""")
def q_text_only(spark, d):
    i, kind = F.col("doc_id"), F.col("doc_id") % 4
    none = F.lit(None).cast("string")
    part = lambda t, text, path, alt: F.struct(F.lit(t).alias("type"), text.alias("text"), path.alias("path"), alt.alias("alt"))
    image = F.concat(F.lit("/i/"), i.cast("string"), F.lit(".png"))
    text, file = part("text", F.col("text"), none, none), part("file", none, F.concat(F.lit("/f/"), i.cast("string"), F.lit(".pdf")), none)
    call = part("tool_use", F.lit("f()"), none, none)
    content = F.when(kind == 0, F.array(text, call)).when(kind == 1, F.array(text, part("image", none, image, F.col("lang")))).when(kind == 2, F.array(part("image", none, image, F.lit("")), file)).otherwise(F.array(call))
    return table(spark, d, "documents").select("doc_id", F.array_join(C.text_only(content), "|").alias("shown"))


@query("""SELECT doc_id, 'data:' || CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END || ';base64,' || to_base64(encode(text)) AS url FROM documents""")
def q_data_urls(spark, d):
    path = F.element_at(F.array(F.lit("a.PNG"), F.lit("b.c.jpeg"), F.lit("noext")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", C.data_url(path, F.encode("text", "UTF-8")).alias("url"))


@query("""SELECT doc_id, left('Top 3 results:' || chr(10) || '1. Result 1 for ' || q || chr(10) || '   https://example.com/1' || chr(10) || '   About ' || q || chr(10) || '2. Result 2 for ' || q || chr(10) || '   https://example.com/2' || chr(10) || '   About ' || q
    || chr(10) || '3. Result 3 for ' || q || chr(10) || '   https://example.com/3' || chr(10) || '   About ' || q, 8000) AS answer FROM (SELECT doc_id, text AS q FROM documents)""")
def q_search_results(spark, d):
    return table(spark, d, "documents").select("doc_id", C.result_list(C.mock_search(F.col("text"))).alias("answer"))


@query("WITH h AS (SELECT source AS category, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), g AS (SELECT category, (n + n % 7) - n AS gap FROM h) SELECT category, unnest(generate_series(1, gap))::INT AS k FROM g WHERE gap > 0")
def q_top_up(spark, d):
    docs = table(spark, d, "documents").filter("source is not null").select(F.col("source").alias("category"))
    return C.top_up(docs, docs.groupBy("category").agg((F.count(F.lit(1)) + F.count(F.lit(1)) % 7).alias("target")))


@query("""WITH t AS (SELECT DISTINCT lang AS category, doc_id // 2 AS source_id FROM documents WHERE doc_id % 5 <> 0), u AS (SELECT lang AS category, max(doc_id % 40) AS top, count(*) AS have FROM documents WHERE doc_id % 50 = 0 GROUP BY 1)
    SELECT category, source_id, 'at_' || category || '_' || lpad((rn + coalesce(top, 0))::VARCHAR, 3, '0') AS task_id FROM (SELECT category, source_id, row_number() OVER (PARTITION BY category ORDER BY source_id) AS rn FROM t) LEFT JOIN u USING (category) WHERE rn + coalesce(have, 0) <= 60""")
def q_allocate_ids(spark, d):
    docs = table(spark, d, "documents")
    tasks = docs.filter("doc_id % 5 <> 0").select(F.col("lang").alias("category"), F.expr("doc_id div 2").alias("source_id"))
    used = docs.filter("doc_id % 50 = 0").select(F.col("lang").alias("category"), (F.col("doc_id") % 40).alias("number"))
    return C.allocate_ids(tasks, used, 60).select("category", "source_id", "task_id")


@query(f"""WITH {TOOL_MESSAGES}, h AS (SELECT DISTINCT session_id, tool_name AS name FROM t WHERE part_type = 'tool_use' UNION SELECT DISTINCT session_id, 'recall_tool_full' FROM t WHERE session_id % 4 = 0),
    p AS (SELECT session_id, count(*) FILTER (part_type = 'tool_result') AS n FROM t GROUP BY 1) SELECT * FROM h UNION SELECT session_id, unnest(['recall_tool_summary', 'recall_tool_full']) FROM p WHERE n > 0""")
def q_inject_recall(spark, d):
    t = tool_messages(spark, d)
    own = t.filter("session_id % 4 = 0").select("session_id", F.lit("recall_tool_full").alias("name")).distinct()
    tools = t.filter("part_type = 'tool_use'").select("session_id", F.col("tool_name").alias("name")).distinct().unionByName(own)
    return C.inject_recall(tools, t.groupBy("session_id").agg(F.count_if(F.col("part_type") == "tool_result").alias("entries")), True)


@query(f"""WITH {MESSAGES}, f AS (SELECT session_id, min(msg_idx) AS pos FROM m WHERE role = 'system' GROUP BY 1), e AS (SELECT session_id, msg_idx::DOUBLE AS pos, role, text FROM m UNION ALL SELECT session_id, pos + 0.5, 'system', '{NOTE}' FROM f)
    SELECT session_id, role, text, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS position FROM e""")
def q_recall_note(spark, d):
    return C.recall_note(messages(spark, d), NOTE).withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {MESSAGES}, p AS (SELECT session_id, msg_idx, role, unnest(generate_series(0, tokens % 3)) AS part_idx FROM m), f AS (SELECT session_id, min(msg_idx) AS first FROM m WHERE role = 'user' GROUP BY 1)
    SELECT session_id, msg_idx, part_idx::BIGINT AS part_idx, coalesce(msg_idx = first AND part_idx = max(part_idx) OVER (PARTITION BY session_id, msg_idx), false) AS cache_mark FROM p LEFT JOIN f USING (session_id)""")
def q_cache_marks(spark, d):
    parts = messages(spark, d).select("session_id", "msg_idx", "role", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") % 3)).alias("part_idx"))
    return C.cache_marks(parts).select("session_id", "msg_idx", "part_idx", "cache_mark")


@query("""SELECT lang AS task_id, doc_id AS position, CASE WHEN doc_id % 2 = 0 AND quality IS NOT NULL THEN 'fresh ' || quality ELSE source END AS output, doc_id % 2 = 0 AND quality IS NULL AS needs_bake, doc_id % 2 = 0 AND quality IS NOT NULL AS baked FROM documents LEFT JOIN labels USING (doc_id)""")
def q_bake(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("task_id"), F.col("doc_id").alias("position"), F.col("source").alias("output"), (F.col("doc_id") % 2 == 0).alias("needs_bake"))
    fresh = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("task_id"), F.col("doc_id").alias("position"), F.concat(F.lit("fresh "), F.col("quality").cast("string")).alias("output"))
    return C.bake(docs, fresh)


@query(f"""WITH {TOOL_MESSAGES}, a AS (SELECT DISTINCT session_id AS task_id, tool_name FROM t WHERE part_type = 'tool_use'), s AS (SELECT DISTINCT session_id AS task_id FROM t), q AS (SELECT task_id, unnest(['web_search', 'text_editor']) AS tool_name FROM s)
    SELECT q.*, CASE WHEN q.task_id NOT IN (SELECT task_id FROM a) THEN 'tools_available is empty' ELSE 'required tool not offered: ' || tool_name END AS reason FROM q WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.task_id = q.task_id AND a.tool_name = q.tool_name)""")
def q_palette_violations(spark, d):
    t = tool_messages(spark, d)
    offered = t.filter("part_type = 'tool_use'").select(F.col("session_id").alias("task_id"), "tool_name").distinct()
    required = t.select(F.col("session_id").alias("task_id")).distinct().select("task_id", F.explode(F.array(F.lit("web_search"), F.lit("text_editor"))).alias("tool_name"))
    return C.palette_violations(required, offered)


@query("""WITH n AS (SELECT doc_id // 8 AS task_id, doc_id % 8 AS node_id, CASE WHEN doc_id % 8 > 0 THEN (doc_id % 8 - 1) // 2 END AS parent_id, CASE WHEN n_chars % 2 = 0 THEN 'composite' ELSE 'exact' END AS strategy FROM documents)
    SELECT task_id, node_id, 'composite without rules' AS reason FROM n WHERE strategy = 'composite' AND NOT EXISTS (SELECT 1 FROM n c WHERE c.task_id = n.task_id AND c.parent_id = n.node_id)""")
def q_composite_violations(spark, d):
    n = table(spark, d, "documents").select(F.expr("doc_id div 8").alias("task_id"), (F.col("doc_id") % 8).alias("node_id"), F.when(F.col("n_chars") % 2 == 0, "composite").otherwise("exact").alias("strategy"))
    return C.composite_violations(n.withColumn("parent_id", F.when(F.col("node_id") > 0, F.expr("(node_id - 1) div 2"))))


@query("WITH i AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS task_idx FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) SELECT task_idx::INT AS task_idx, doc_id, source AS task FROM documents d JOIN i ON i.task_idx = d.doc_id % 9 - 1".replace("doc_id, source AS task", "d.doc_id, i.source AS task"))
def q_pick_by_index(spark, d):
    docs = table(spark, d, "documents")
    listed = docs.agg(F.array_sort(F.collect_set("source")).alias("items"))
    return C.pick_by_index(docs.select("doc_id", (F.col("doc_id") % 9 - 1).cast("int").alias("task_idx")), listed).select("task_idx", "doc_id", "task")


@query("""SELECT doc_id, concat_ws(chr(10) || chr(10), 'You are an agent.', nullif(trim(ctx), ''), CASE WHEN n > 0 THEN '# Available tools' || chr(10) || chr(10) || 'You have ' || n || ' tool' || CASE WHEN n = 1 THEN '' ELSE 's' END || '.' || chr(10) || chr(10) || CASE n WHEN 1 THEN '- **find** — finds' ELSE '- **find** — finds' || chr(10) || '- **read** — reads' END
    || chr(10) || chr(10) || 'Use them.' END, 'Be brief.') AS prompt FROM (SELECT doc_id, doc_id % 3 AS n, CASE WHEN doc_id % 2 = 0 THEN text ELSE '  ' END AS ctx FROM documents)""")
def q_system_prompt(spark, d):
    tool = lambda name: F.struct(F.lit(name).alias("name"), F.lit(f"{name}s").alias("line"))
    tools = F.slice(F.array(tool("find"), tool("read")), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    context = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("  ")
    return table(spark, d, "documents").select("doc_id", C.system_prompt("You are an agent.", "Be brief.", "Use them.", context, tools).alias("prompt"))
