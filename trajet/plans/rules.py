"""Queries over rule trees, collated orders and left-out calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rules
from ..sources.derive import table
from .registry import query

DEPTH = 12
GRID = [200.0, 500.0, 1000.0, 2000.0, 4000.0]


@query(f"""WITH RECURSIVE n AS (SELECT doc_id // 12 AS task_id, doc_id % 12 AS k, CASE WHEN doc_id % 12 = 0 THEN NULL WHEN (doc_id // 12) % 3 = 0 THEN (doc_id % 12 - 1) // 2 WHEN (doc_id // 12) % 3 = 1 THEN doc_id % 12 - 1 ELSE (doc_id % 12) // 5 * 4 END AS up, (n_chars % 3 > 0)::INT::DOUBLE AS leaf FROM documents WHERE doc_id >= 0 AND doc_id < (SELECT max(doc_id) + 1 FROM documents) // 12 * 12),
    m AS (SELECT n.*, CASE WHEN EXISTS (SELECT 1 FROM n c WHERE c.task_id = n.task_id AND c.up = n.k) THEN ['all', 'any', 'mean'][(n.k + n.task_id) % 3 + 1] END AS rule FROM n),
    d AS (SELECT task_id, k, 0 AS level FROM m WHERE up IS NULL UNION ALL SELECT m.task_id, m.k, d.level + 1 FROM m JOIN d ON d.task_id = m.task_id AND d.k = m.up),
    x{DEPTH} AS (SELECT NULL::BIGINT AS task_id, NULL::BIGINT AS up, NULL::DOUBLE AS score WHERE false),
    {", ".join(f'''x{i} AS (SELECT m.task_id, m.up, CASE WHEN m.rule IS NULL THEN m.leaf WHEN m.rule = 'all' THEN (min(c.score) >= 1)::INT WHEN m.rule = 'any' THEN (max(c.score) >= 1)::INT ELSE avg(c.score) END AS score
        FROM m JOIN d ON d.task_id = m.task_id AND d.k = m.k AND d.level = {i} LEFT JOIN x{i + 1} c ON c.task_id = m.task_id AND c.up = m.k GROUP BY m.task_id, m.up, m.k, m.rule, m.leaf)''' for i in range(DEPTH - 1, -1, -1))}
    SELECT task_id, round(score, 6) AS score FROM x0""")
def q_rule_trees(spark, d):
    """Twelve documents a task: a binary tree, a chain or a fan of fans, so depths are from two to eleven."""
    docs = table(spark, d, "documents").filter("doc_id >= 0")
    last = docs.agg(F.expr("(max(doc_id) + 1) div 12 * 12").alias("_upto"))
    n = docs.join(F.broadcast(last)).filter("doc_id < _upto").select(F.expr("doc_id div 12").alias("task_id"), (F.col("doc_id") % 12).alias("node_id"), (F.col("n_chars") % 3 > 0).cast("int").cast("double").alias("score"))
    kind = F.col("task_id") % 3
    up = F.when(F.col("node_id") == 0, None).when(kind == 0, F.expr("(node_id - 1) div 2")).when(kind == 1, F.col("node_id") - 1).otherwise(F.expr("node_id div 5 * 4")).cast("long")
    n = n.withColumn("parent_id", up)
    inner = n.select("task_id", F.col("parent_id").alias("node_id"), F.lit(True).alias("_has")).dropna().distinct()
    rule = F.when(F.col("_has"), F.element_at(F.array(F.lit("all"), F.lit("any"), F.lit("mean")), ((F.col("node_id") + F.col("task_id")) % 3 + 1).cast("int")))
    trees = n.join(inner, ["task_id", "node_id"], "left").select("task_id", "node_id", "parent_id", rule.alias("rule"), "score")
    return rules.rule_scores(trees).select("task_id", F.round("score", 6).alias("score"))


NAME = "regexp_replace(lower(source), '[^a-z]', '', 'g')"
CASES = f"CASE doc_id % 6 WHEN 0 THEN {NAME} WHEN 1 THEN upper({NAME}) WHEN 2 THEN upper({NAME}[1]) || {NAME}[2:] WHEN 3 THEN replace(replace({NAME}, 'e', 'é'), 'o', 'ö') WHEN 4 THEN upper(replace({NAME}, 'e', 'é')) ELSE {NAME} || 'z' END"
#: What the order says, spelt out: letters, then accents, then case with small letters first, then code points.
SPELT = "strip_accents(lower(name)), lower(name), list_transform(string_split(name, ''), lambda c: c <> lower(c)), name"


@query(f"SELECT lang, name, row_number() OVER (PARTITION BY lang ORDER BY {SPELT})::BIGINT AS rank FROM (SELECT DISTINCT lang, {CASES} AS name FROM documents)")
def q_collated_order(spark, d):
    name = F.regexp_replace(F.lower("source"), "[^a-z]", "")
    accents = F.replace(F.replace(name, F.lit("e"), F.lit("é")), F.lit("o"), F.lit("ö"))
    cases = [name, F.upper(name), F.concat(F.upper(F.substring(name, 1, 1)), F.expr("substring(regexp_replace(lower(source), '[^a-z]', ''), 2)")), accents, F.upper(F.replace(name, F.lit("e"), F.lit("é"))), F.concat(name, F.lit("z"))]
    shown = F.element_at(F.array(*cases), (F.col("doc_id") % 6 + 1).cast("int"))
    names = table(spark, d, "documents").select("lang", shown.alias("name")).distinct()
    return names.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*rules.collated("name"))).cast("long"))


@query(f"""WITH p AS (SELECT doc_id % 15 AS trace_id, n_chars AS size, doc_id % 4 = 0 AS useful FROM documents), g(threshold) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in GRID)}), t AS (SELECT DISTINCT trace_id FROM p),
    f AS (SELECT t.trace_id, threshold, sum(CASE WHEN p.size > threshold AND p.trace_id <> t.trace_id THEN p.size ELSE 0 END)::DOUBLE AS saved, count(*) FILTER (p.size > threshold AND useful AND p.trace_id <> t.trace_id) AS lost,
        sum(CASE WHEN p.size > threshold AND p.trace_id = t.trace_id THEN p.size ELSE 0 END)::DOUBLE AS own_saved, count(*) FILTER (p.size > threshold AND useful AND p.trace_id = t.trace_id) AS own_lost FROM t, g, p GROUP BY 1, 2)
    SELECT trace_id, threshold, saved, lost, NOT EXISTS (SELECT 1 FROM f o WHERE o.trace_id = f.trace_id AND o.saved >= f.saved AND o.lost <= f.lost AND (o.saved > f.saved OR o.lost < f.lost)) AS on_front, own_saved, own_lost FROM f""")
def q_calibrate_left_out(spark, d):
    traces = table(spark, d, "documents").select((F.col("doc_id") % 15).alias("trace_id"), F.col("n_chars").alias("size"), (F.col("doc_id") % 4 == 0).alias("useful"))
    return rules.calibrate_left_out(traces, GRID)
