"""Queries over run records: cells, costs, classes, tests, samples and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..sources.derive import RUN_RECORDS, STRATEGIES, run_records, table
from .registry import query

R = RUN_RECORDS
R6 = lambda c: F.round(c, 6)
HASH = lambda x: f"('0x' || substr(sha256({x}), 1, 8))::BIGINT"
N_PERM, REPS = 10_000, 10_000

CELLS = """c AS (SELECT bench, config_id, seed, count(*)::BIGINT AS n, round(avg(score), 6) AS accuracy, round(sum(cost_usd), 8) AS cost_usd, round(sum(n_errors) / count(*)::DOUBLE, 6) AS err_rate,
    round(sum(judge_cost_usd), 6) AS judge_cost_usd, count(*) FILTER (has_obs)::BIGINT AS obs_n, count(*) FILTER (has_off)::BIGINT AS off_n, count(*) FILTER (has_rec)::BIGINT AS rec_n,
    sum(input_tokens)::BIGINT AS input_tokens, sum(cache_read)::BIGINT AS cache_read_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM r GROUP BY 1, 2, 3)"""


def cells(spark, d):
    c = E.cells(run_records(spark, d))
    return c.withColumns({x: F.round(x, 8 if x == "cost_usd" else 6) for x in ("accuracy", "cost_usd", "err_rate", "judge_cost_usd")})


@query(f"WITH {R}, {CELLS} SELECT * FROM c")
def q_cell_summary(spark, d):
    return cells(spark, d)


@query(f"WITH {R}, {CELLS} SELECT bench, config_id, seed, CASE WHEN input_tokens > 0 THEN printf('%.1f%%', cache_read_tokens / input_tokens::DOUBLE * 100) ELSE '—' END AS cache_pct FROM c")
def q_cache_rate(spark, d):
    share = F.format_string("%.1f%%", F.col("cache_read_tokens") / F.col("input_tokens") * 100)
    return cells(spark, d).select(*E.CELL, F.when(F.col("input_tokens") > 0, share).otherwise("—").alias("cache_pct"))


@query(f"WITH {R} SELECT bench, count(*)::BIGINT AS n, round(sum(cost_usd), 8) AS cost_usd, round(sum(judge_cost_usd), 6) AS judge_cost_usd FROM r GROUP BY ROLLUP (bench)")
def q_totals(spark, d):
    return run_records(spark, d).rollup("bench").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 8).alias("cost_usd"), R6(F.sum("judge_cost_usd")).alias("judge_cost_usd"))


SIGNALS = """sg AS (SELECT task_id, CASE WHEN t % 2 = 0 THEN signal WHEN task_id % 2 = 0 THEN 'mixed' END AS class FROM r, generate_series(0, n_turns - 1) AS g(t)),
    md AS (SELECT task_id, class FROM (SELECT task_id, class, row_number() OVER (PARTITION BY task_id ORDER BY count(*) DESC, class) AS rn FROM sg WHERE class IS NOT NULL GROUP BY 1, 2) WHERE rn = 1)"""


@query(f"WITH {R}, {SIGNALS} SELECT * FROM md")
def q_class_mode(spark, d):
    return E.mode_class(run_records(spark, d))


@query(f"""WITH {R}, {SIGNALS} SELECT coalesce(class, 'unknown') AS class, count(*)::BIGINT AS n, round(avg(score), 6) AS mean_primary, round(coalesce(stddev_samp(score), 0) / sqrt(count(*)), 6) AS stderr
    FROM r LEFT JOIN md USING (task_id) GROUP BY 1""")
def q_class_breakdown(spark, d):
    r = run_records(spark, d)
    b = E.class_breakdown(r.join(E.mode_class(r), "task_id", "left"))
    return b.withColumns({c: R6(F.col(c)) for c in ("mean_primary", "stderr")})


TURN_EVENTS = f"""tn AS (SELECT task_id, t::INT AS turn_index, CASE WHEN t = 0 AND has_rec THEN ['r' || task_id] ELSE []::VARCHAR[] END AS own, CASE WHEN t % 2 = 0 THEN signal WHEN task_id % 2 = 0 THEN 'mixed' END AS class_signal FROM r, generate_series(0, n_turns - 1) AS g(t)),
    ev AS (SELECT task_id, k AS seq, ['compaction', 'recall', 'class_signal'][((task_id + k) % 3 + 1)::INT] AS kind, ((task_id + k // 3) % 5)::INT AS turn_index, ['conversational', 'tool_heavy', 'mixed'][((task_id * 2 + k) % 3 + 1)::INT] AS payload FROM r, generate_series(0, 6) AS g(k)),
    ea AS (SELECT task_id, turn_index, list(payload ORDER BY seq) FILTER (kind = 'compaction') AS c, list(payload ORDER BY seq) FILTER (kind = 'recall') AS rc, arg_max(payload, seq) FILTER (kind = 'class_signal') AS sg FROM ev GROUP BY 1, 2)"""


@query(f"""WITH {R}, {TURN_EVENTS} SELECT task_id, turn_index, coalesce(array_to_string(c, ','), '') AS compactions, CASE WHEN len(own) > 0 THEN array_to_string(own, ',') ELSE coalesce(array_to_string(rc, ','), '') END AS recalls, coalesce(sg, class_signal) AS class_signal
    FROM tn LEFT JOIN ea USING (task_id, turn_index)""")
def q_turn_event_merge(spark, d):
    """Events of each task, some of no turn of it and some of turns with recalls of their own."""
    r = run_records(spark, d)
    none = F.array().cast("array<string>")
    turns = r.select("task_id", F.explode("turns").alias("t")).select("task_id", "t.turn_index", none.alias("compaction_events"), "t.recall_events", "t.class_signal")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    i, k = F.col("task_id"), F.col("seq")
    events = r.select("task_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("seq")).select(
        "task_id", "seq", pick(["compaction", "recall", "class_signal"], i + k).alias("kind"), ((i + F.floor(k / 3)) % 5).cast("int").alias("turn_index"), pick(["conversational", "tool_heavy", "mixed"], i * 2 + k).alias("payload")
    )
    m = E.merge_turn_events(turns, events)
    return m.select("task_id", "turn_index", F.array_join("compaction_events", ",").alias("compactions"), F.array_join("recall_events", ",").alias("recalls"), "class_signal")


@query(f"""WITH {R}, o AS (SELECT strategy, latency_s, row_number() OVER (PARTITION BY strategy ORDER BY latency_s) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM r)
    SELECT strategy, any_value(n)::BIGINT AS n, max(latency_s) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(latency_s) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95, round(median(latency_s), 6) AS median FROM o GROUP BY 1""")
def q_strategy_percentiles(spark, d):
    return E.percentiles(run_records(spark, d), "strategy", "latency_s").withColumn("median", R6(F.col("median")))


@query(f"""WITH {R} SELECT bench, {', '.join(f"round(avg(score) FILTER (strategy = '{s}'), 6) AS {s}" for s in STRATEGIES)} FROM r GROUP BY 1""")
def q_pivot_by_type(spark, d):
    p = run_records(spark, d).groupBy("bench").pivot("strategy", list(STRATEGIES)).agg(R6(F.avg("score")))
    return p


PRICES = [("full_context", 3.0, 15.0, 0.1), ("naive_truncation", 0.3, 2.5, 0.25), ("rolling_summary", 0.75, 4.5, None), ("type_aware", 0.4, 1.6, 0.25)]
PRICE_SQL = "pr(strategy, rate_in, rate_out, factor) AS (VALUES " + ", ".join(f"('{s}', {a}::DOUBLE, {b}::DOUBLE, {'NULL' if f is None else f}::DOUBLE)" for s, a, b, f in PRICES) + ")"


@query(f"""WITH {R}, {PRICE_SQL} SELECT strategy, count(*)::BIGINT AS n, round(sum(coalesce((greatest(0, input_tokens - cache_read) * rate_in + cache_read * rate_in * coalesce(factor, 1) + output_tokens * rate_out) / 1e6, 0)), 6) AS usd
    FROM r LEFT JOIN pr USING (strategy) GROUP BY 1""")
def q_cost_model(spark, d):
    prices = spark.createDataFrame(PRICES, "strategy string, rate_in double, rate_out double, factor double")
    r = run_records(spark, d).join(F.broadcast(prices), "strategy", "left")
    usd = E.cost_with_cache(F.col("input_tokens"), F.col("cache_read"), F.col("output_tokens"), F.col("rate_in"), F.col("rate_out"), F.col("factor"))
    return r.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), R6(F.sum(F.coalesce(usd, F.lit(0.0)))).alias("usd"))


@query(f"""WITH {R} SELECT ['driver', 'judge', 'compactor'][(task_id % 3 + 1)::INT] AS call_kind, count(*)::BIGINT AS calls, round(sum(cost_usd), 8) AS usd, sum(input_tokens)::BIGINT AS tokens_in,
    sum(output_tokens)::BIGINT AS tokens_out, round(count(*) FILTER (cache_read > 0) / greatest(1, count(*))::DOUBLE, 6) AS hit_rate FROM r GROUP BY 1""")
def q_spend_by_kind(spark, d):
    kind = F.element_at(F.array(F.lit("driver"), F.lit("judge"), F.lit("compactor")), (F.col("task_id") % 3 + 1).cast("int"))
    n = F.count(F.lit(1))
    return run_records(spark, d).groupBy(kind.alias("call_kind")).agg(
        n.alias("calls"), F.round(F.sum("cost_usd"), 8).alias("usd"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"),
        R6(F.count_if(F.col("cache_read") > 0) / F.greatest(F.lit(1), n)).alias("hit_rate"),
    )


@query(f"WITH {R} SELECT bench, count(*) FILTER (score > score_b)::BIGINT AS wins, count(*) FILTER (score < score_b)::BIGINT AS losses, count(*) FILTER (score = score_b)::BIGINT AS ties FROM r GROUP BY GROUPING SETS ((bench), ())")
def q_head_to_head(spark, d):
    r = run_records(spark, d)
    a, b = r.select("task_id", "bench", "score"), r.select("task_id", "score_b")
    return a.join(b, "task_id").rollup("bench").agg(
        F.count_if(F.col("score") > F.col("score_b")).alias("wins"), F.count_if(F.col("score") < F.col("score_b")).alias("losses"), F.count_if(F.col("score") == F.col("score_b")).alias("ties")
    )


ONES = " + ".join(f"bit_count(('0x' || substr(h, {1 + 15 * w}, 15))::BIGINT >> (60 - greatest(0, least(60, k - block * 240 - {60 * w}))))" for w in range(4))
PERM = f"""df AS (SELECT task_id, score - score_b AS diff FROM r), tt AS (SELECT count(*) AS n, coalesce(avg(diff), 0) AS delta, coalesce(sum(diff), 0) AS s FROM df),
    vk AS (SELECT abs(diff) AS v, count(*) AS k FROM df WHERE diff <> 0 GROUP BY 1),
    bl AS (SELECT v, k, perm, block, sha256(printf('%.9f', v) || ':' || perm || ':' || block || ':42') AS h FROM (SELECT v, k, perm, unnest(generate_series(0, (k - 1) // 240)) AS block FROM vk, generate_series(0, {N_PERM - 1}) AS g(perm))),
    pv AS (SELECT perm, v, k, sum({ONES}) AS plus FROM bl GROUP BY 1, 2, 3),
    fl AS (SELECT perm, sum(v * (2 * plus - k)) AS x FROM pv GROUP BY 1),
    pm AS (SELECT coalesce(x, 0) AS x FROM generate_series(0, {N_PERM - 1}) AS g(perm) LEFT JOIN fl USING (perm))"""


@query(f"WITH {R}, {PERM} SELECT max(n)::BIGINT AS n, round(max(delta), 6) AS delta, round(count(*) FILTER (abs(x) >= abs(s) - 1e-12) / {N_PERM}.0::DOUBLE, 6) AS p_value, round((count(*) FILTER (abs(x) >= abs(s) - 1e-12) + 1) / {N_PERM + 1}.0::DOUBLE, 6) AS p_pooled FROM pm, tt")
def q_paired_permutation(spark, d):
    diffs = run_records(spark, d).select("task_id", (F.col("score") - F.col("score_b")).alias("diff"))
    p = E.permutation_test(diffs, N_PERM)
    return p.withColumns({c: R6(F.col(c)) for c in ("delta", "p_value", "p_pooled")})


@query(f"""WITH {R}, df AS (SELECT round(8 * (score - score_b) + task_id % 5 - 2)::BIGINT AS x FROM r),
    hi AS (SELECT abs(x) AS q, count(*) AS k FROM df WHERE x <> 0 GROUP BY 1),
    ft AS (SELECT sum(q * k)::BIGINT AS total, sqrt(sum(q * q * k)::DOUBLE) AS sd, (SELECT abs(sum(x))::BIGINT FROM df) AS s FROM hi),
    np AS (SELECT *, 2 * least(total, floor(least(s, 8 * sd) + 8 * sd)::BIGINT + 1) + 1 AS points FROM ft),
    wv AS (SELECT j, 2 * pi() * j / points AS th, s, points FROM np, generate_series(1, (SELECT points // 2 FROM np)) AS g(j)),
    ph AS (SELECT j, any_value(th) AS th, any_value(s) AS s, any_value(points) AS points, exp(sum(k * ln(greatest(abs(cos(q * th)), 1e-300)))) * CASE WHEN sum(CASE WHEN cos(q * th) < 0 THEN k ELSE 0 END) % 2 = 1 THEN -1 ELSE 1 END AS f FROM wv, hi GROUP BY 1),
    pv AS (SELECT greatest(0, least(1, 1 - (2 * any_value(s) - 1 + 2 * sum(f * sin((s - 0.5) * th) / sin(th / 2))) / any_value(points))) AS p FROM ph)
    SELECT (SELECT count(*) FROM df) AS n, round((SELECT avg(x / 8.0::DOUBLE) FROM df), 6) AS delta, round(p, 6) AS p_value, round((p * {N_PERM} + 1) / {N_PERM + 1}.0::DOUBLE, 6) AS p_pooled FROM pv""")
def q_sign_flip(spark, d):
    """Differences in eighths."""
    diffs = run_records(spark, d).select((F.col("score") - F.col("score_b") + (F.col("task_id") % 5 - 2) / 8).alias("diff"))
    p = E.sign_flip_test(diffs, N_PERM)
    return p.withColumns({c: R6(F.col(c)) for c in ("delta", "p_value", "p_pooled")})


@query(f"""WITH {R}, v AS (SELECT (8 * (0.5 * score + task_id % 5 * 0.125))::BIGINT AS e FROM r), b AS (SELECT count(*) AS n, min(e) AS least, avg(e / 8.0::DOUBLE) AS acc FROM v),
    h AS (SELECT (e - least)::DOUBLE AS q, count(*) / any_value(n)::DOUBLE AS p FROM v, b GROUP BY 1),
    m AS (SELECT sum(q * p) AS mu, sqrt(sum(q * q * p) - sum(q * p) ** 2) AS sd, max(q) AS top FROM h),
    w AS (SELECT *, greatest(0, trunc(n * mu - (8 * sd * sqrt(n) + 1)))::BIGINT AS first, least(n * top, trunc(n * mu + 8 * sd * sqrt(n) + 1) + 1)::BIGINT AS last FROM m, b),
    k AS (SELECT *, CASE WHEN (last - first + 1) % 2 = 1 THEN last - first + 1 ELSE last - first + 2 END AS points FROM w),
    fr AS (SELECT 2 * pi() * j / points AS th FROM k, generate_series(1, (SELECT points // 2 FROM k)) AS g(j)),
    cf AS (SELECT th, sum(p * cos(q * th)) AS re, sum(p * sin(q * th)) AS im FROM fr, h GROUP BY 1),
    wa AS (SELECT th, exp((SELECT n FROM b) * ln(greatest(sqrt(re * re + im * im), 1e-300))) AS size, (SELECT n FROM b) * atan2(im, re) AS turn FROM cf),
    cd AS (SELECT first + x AS x, (x + 1 + 2 * coalesce(sum(size * cos(turn - th * (first + x / 2.0::DOUBLE)) * sin((x + 1) * th / 2) / sin(th / 2)), 0)) / any_value(points) AS below FROM k, generate_series(0, (SELECT points - 1 FROM k)) AS g(x), wa WHERE size > 1e-18 GROUP BY first, x)
    SELECT round(any_value(acc), 6) AS accuracy, round((min(x) FILTER (below >= {int(0.025 * REPS) + 1} / {REPS}.0::DOUBLE - 1e-12) / any_value(n)::DOUBLE + any_value(least)) / 8, 6) AS lo, round((min(x) FILTER (below >= {int(0.975 * REPS) + 1} / {REPS}.0::DOUBLE - 1e-12) / any_value(n)::DOUBLE + any_value(least)) / 8, 6) AS hi FROM cd, b""")
def q_resampled_interval(spark, d):
    """Fractional scores, in eighths."""
    b = E.resampled_interval(run_records(spark, d).select((0.5 * F.col("score") + F.col("task_id") % 5 * 0.125).alias("score")), REPS)
    return b.select(*(R6(F.col(c)).alias(c) for c in b.columns))


HITS = " + ".join(f"CASE WHEN block * 8 + {j} < n AND ('0x' || substr(h, {1 + 8 * j}, 8))::BIGINT % n < k THEN 1 ELSE 0 END" for j in range(8))


@query(f"""WITH {R}, z AS (SELECT count(*) AS n, sum(score)::BIGINT AS k FROM r),
    bl AS (SELECT n, k, rep, block, sha256(rep || ':' || block || ':0') AS h FROM (SELECT n, k, rep, unnest(generate_series(0, (n - 1) // 8)) AS block FROM z, generate_series(0, {REPS - 1}) AS g(rep))),
    bm AS (SELECT rep, sum({HITS}) / any_value(n)::DOUBLE AS m FROM bl GROUP BY 1),
    rk AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS rn FROM bm)
    SELECT round((SELECT k / n::DOUBLE FROM z), 6) AS accuracy, round(max(m) FILTER (rn = {int(0.025 * REPS)}), 6) AS lo, round(max(m) FILTER (rn = {int(0.975 * REPS)}), 6) AS hi FROM rk""")
def q_bootstrap_ci(spark, d):
    b = E.bootstrap(run_records(spark, d).select("score"), REPS)
    return b.select(*(R6(F.col(c)).alias(c) for c in b.columns))


@query(f"""WITH {R}, w AS (SELECT bench, sum(score) AS k, count(*)::DOUBLE AS n FROM r GROUP BY 1)
    SELECT bench, round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS lo,
        round(least(1, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS hi FROM w""".replace("1.96", "1.96::DOUBLE"))
def q_wilson(spark, d):
    w = run_records(spark, d).groupBy("bench").agg(F.sum("score").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    lo, hi = E.wilson(F.col("k"), F.col("n"))
    return w.select("bench", R6(lo).alias("lo"), R6(hi).alias("hi"))


BY_STRATEGY = "st AS (SELECT strategy, round(avg(score), 9) AS a, round(avg(score_b), 9) AS b FROM r GROUP BY 1)"


def by_strategy(spark, d):
    return run_records(spark, d).groupBy("strategy").agg(F.round(F.avg("score"), 9).alias("a"), F.round(F.avg("score_b"), 9).alias("b"))


@query(f"""WITH {R}, {BY_STRATEGY}, rk AS (SELECT row_number() OVER (ORDER BY a DESC, strategy) AS ra, row_number() OVER (ORDER BY b DESC, strategy) AS rb FROM st),
    pp AS (SELECT count(*) FILTER (sign(l.a - x.a) = sign(l.b - x.b))::BIGINT AS pair_matches, count(*)::BIGINT AS pair_total FROM st l JOIN st x ON l.strategy < x.strategy)
    SELECT round(1 - 6 * sum((ra - rb) ** 2) / (count(*) * (count(*) ** 2 - 1))::DOUBLE, 6) AS rho, count(*)::BIGINT AS n, any_value(pair_matches) AS pair_matches, any_value(pair_total) AS pair_total FROM rk, pp""")
def q_spearman(spark, d):
    s = by_strategy(spark, d)
    rho = E.spearman(s.select("strategy", F.col("a").alias("x")), s.select("strategy", F.col("b").alias("x")), "strategy", "x")
    return rho.join(E.sign_agreement(s, "strategy", "a", "b")).withColumn("rho", R6(F.col("rho")))


@query("""WITH q AS (SELECT lang, floor(100 * c / sum(c) OVER ())::BIGINT AS base, round(100 * c / sum(c) OVER () - floor(100 * c / sum(c) OVER ()), 9) AS rest FROM (SELECT lang, count(*)::DOUBLE AS c FROM documents GROUP BY 1)),
    qq AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q)
    SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id || ':42')) AS rn FROM documents) JOIN qq USING (lang) WHERE rn <= quota""")
def q_stratified_sample(spark, d):
    return E.stratified(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 100).select("doc_id", "lang")


@query("""WITH q AS (SELECT lang, 50 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY lang) - 1 < 50 % count(*) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT DISTINCT lang FROM documents))
    SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id || ':42')) AS rn FROM documents) JOIN q USING (lang) WHERE rn <= quota""")
def q_equal_split(spark, d):
    return E.equal_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 50).select("doc_id", "lang")


@query("SELECT doc_id FROM documents ORDER BY sha256(doc_id || ':7') LIMIT 20")
def q_simple_sample(spark, d):
    key = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":7")), 256)
    return table(spark, d, "documents").select("doc_id").orderBy(key).limit(20).orderBy("doc_id")


@query("SELECT l.doc_id AS task_id, d.lang, d.doc_id IS NOT NULL AS found FROM labels l LEFT JOIN (SELECT doc_id, lang FROM documents WHERE lang <> 'de') d ON l.doc_id = d.doc_id")
def q_subset_lookup(spark, d):
    known = table(spark, d, "documents").filter("lang <> 'de'").select("doc_id", "lang", F.lit(True).alias("_f"))
    return table(spark, d, "labels").select("doc_id").join(known, "doc_id", "left").select(F.col("doc_id").alias("task_id"), "lang", F.coalesce("_f", F.lit(False)).alias("found"))


@query("SELECT doc_id AS task_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def q_resume_pending(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select(F.col("doc_id").alias("task_id"), "source")


@query("""SELECT bench, config_id, seed::INT AS seed, task_id, rn FROM (SELECT lang AS bench, doc_id AS task_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents), (VALUES ('full'), ('compact')) c(config_id), (VALUES (0), (1)) s(seed) WHERE rn <= 5""")
def q_work_grid(spark, d):
    capped = table(spark, d, "documents").select(F.col("lang").alias("bench"), F.col("doc_id").alias("task_id"), F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).cast("long").alias("rn")).filter("rn <= 5")
    # the grid's axes are short lists of the caller's: exploded, not joined
    return capped.select("bench", F.explode(F.array(F.lit("full"), F.lit("compact"))).alias("config_id"), "task_id", "rn").select("bench", "config_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seed"), "task_id", "rn")


BREAK_SQL = """SELECT user_id, event_id, bool_or(trips) OVER w AS halted FROM (SELECT *, count(*) OVER w >= 20 AND avg(value) OVER w * 1000 > 1.5 * 30000 AS trips FROM (SELECT user_id, event_id, ts, value FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@query(BREAK_SQL)
def q_cost_breaker(spark, d):
    """Each user's events are a sweep's records."""
    sweeps = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return E.breaker(sweeps, ["ts", "event_id"], "value", 1000, 30000.0, by=("user_id",)).select("user_id", "event_id", "halted")


@query("""SELECT user_id, min(rn)::BIGINT AS halted_at FROM (SELECT user_id, row_number() OVER w AS rn, sum(value) OVER w AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn % 5 = 0 AND spent > 600 GROUP BY 1""")
def q_spend_halt(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rn"), F.sum("value").over(w).alias("spent"))
    return e.filter("rn % 5 = 0 and spent > 600").groupBy("user_id").agg(F.min("rn").cast("long").alias("halted_at"))


@query(f"""WITH {R}, pc AS (SELECT bench || '/' || config_id || '/' || seed AS path, count(*) AS n, sum(n_errors) / count(*)::DOUBLE AS err, coalesce(stddev_pop(score), 0) AS sd, count(*) FILTER (has_obs OR has_off) AS events FROM r GROUP BY 1)
    SELECT 'error' AS severity, bench || '/' || config_id || '/' || seed || '#' || task_id AS path, 'no tokens' AS "check" FROM r WHERE input_tokens + output_tokens <= 0
    UNION ALL SELECT 'warn', bench || '/' || config_id || '/' || seed || '#' || task_id, 'cost is zero' FROM r WHERE cost_usd = 0 AND input_tokens + output_tokens > 0
    UNION ALL SELECT 'error', path, 'error rate' FROM pc WHERE err >= 0.1::DOUBLE UNION ALL SELECT 'warn', path, 'constant scores' FROM pc WHERE n >= 3 AND sd = 0 UNION ALL SELECT 'warn', path, 'no compaction events' FROM pc WHERE n >= 3 AND events = 0""")
def q_quality_checks(spark, d):
    return E.issues(run_records(spark, d))


@query(f"""WITH {R} SELECT task_id, strategy, input_tokens, CASE strategy WHEN 'full_context' THEN false WHEN 'naive_truncation' THEN input_tokens > 1.2 * 400 ELSE input_tokens > 1.5 * 400 END AS over_budget FROM r""")
def q_budget_policy(spark, d):
    over = F.when(F.col("strategy") == "full_context", False).when(F.col("strategy") == "naive_truncation", F.col("input_tokens") > 1.2 * 400).otherwise(F.col("input_tokens") > 1.5 * 400)
    return run_records(spark, d).select("task_id", "strategy", "input_tokens", over.alias("over_budget"))


@query(f"WITH {R} SELECT DISTINCT a.task_id FROM r a WHERE seed = 0 AND strategy = 'full_context' INTERSECT SELECT task_id FROM r WHERE score = 1")
def q_common_ids(spark, d):
    r = run_records(spark, d)
    return r.filter("seed = 0 and strategy = 'full_context'").select("task_id").intersect(r.filter("score = 1").select("task_id"))


@query(f"WITH {R} SELECT pool, count(*)::BIGINT AS n, round(avg(diff), 6) AS delta FROM (SELECT 'seed0' AS pool, score - score_b AS diff FROM r WHERE seed = 0 UNION ALL SELECT 'seed1', score - score_b FROM r WHERE seed = 1 UNION ALL SELECT 'pooled', score - score_b FROM r) GROUP BY 1")
def q_pooled_pairs(spark, d):
    r = run_records(spark, d).select(F.concat(F.lit("seed"), F.col("seed").cast("string")).alias("pool"), (F.col("score") - F.col("score_b")).alias("diff"))
    pools = r.select(F.explode(F.array("pool", F.lit("pooled"))).alias("pool"), "diff")
    return pools.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("diff")).alias("delta"))


@query(f"WITH {R} SELECT config_id, count(*)::BIGINT AS seeds, round(avg(acc), 6) AS accuracy, round(avg(cost), 6) AS cost_per_task FROM (SELECT config_id, seed, avg(score) AS acc, sum(cost_usd) / count(*) AS cost FROM r GROUP BY 1, 2) GROUP BY 1")
def q_seed_means(spark, d):
    s = run_records(spark, d).groupBy("config_id", "seed").agg(F.avg("score").alias("acc"), F.avg("cost_usd").alias("cost"))
    return s.groupBy("config_id").agg(F.count(F.lit(1)).alias("seeds"), R6(F.avg("acc")).alias("accuracy"), R6(F.avg("cost")).alias("cost_per_task"))


@query(f"""WITH {R} SELECT strategy, round(avg(score), 6) AS pass_at_1, round(avg(n_turns), 6) AS mean_steps, round(avg(cost_usd), 6) AS usd_per_episode, count(*)::BIGINT AS n FROM r GROUP BY 1""")
def q_episode_rollup(spark, d):
    return run_records(spark, d).groupBy("strategy").agg(R6(F.avg("score")).alias("pass_at_1"), R6(F.avg(F.size("turns"))).alias("mean_steps"), R6(F.avg("cost_usd")).alias("usd_per_episode"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {R}, s AS (SELECT sum(cost_usd) AS ingest FROM r WHERE strategy = 'type_aware') SELECT config_id, count(*)::BIGINT AS n, round(avg(score), 6) AS accuracy, round(avg(cost_usd) + any_value(ingest) / count(*), 6) AS amortised_usd FROM r, s GROUP BY 1""")
def q_memory_rollup(spark, d):
    r = run_records(spark, d)
    ingest = r.filter("strategy = 'type_aware'").agg(F.sum("cost_usd").alias("ingest"))
    per = r.groupBy("config_id").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("score")).alias("accuracy"), F.avg("cost_usd").alias("c"))
    return per.join(F.broadcast(ingest)).select("config_id", "n", "accuracy", R6(F.col("c") + F.col("ingest") / F.col("n")).alias("amortised_usd"))


@query(f"""WITH {R}, p AS (SELECT config_id, round(avg(score), 6) AS accuracy, round(avg(cost_usd), 9) AS cost FROM r GROUP BY 1)
    SELECT config_id, accuracy, round(cost, 6) AS cost, NOT EXISTS (SELECT 1 FROM p q WHERE q.accuracy >= p.accuracy AND q.cost <= p.cost AND (q.accuracy > p.accuracy OR q.cost < p.cost)) AS on_front FROM p""")
def q_pareto_rows(spark, d):
    """Rows of the accuracy and cost table; the dominance flag is an extension. A running minimum finds it, no self-join."""
    p = run_records(spark, d).groupBy("config_id").agg(R6(F.avg("score")).alias("accuracy"), F.round(F.avg("cost_usd"), 9).alias("cost"))
    better = F.min("cost").over(Window.orderBy((-F.col("accuracy") * 1_000_000).cast("long")).rangeBetween(Window.unboundedPreceding, -1))
    same = F.min("cost").over(Window.partitionBy("accuracy"))
    front = (F.col("cost") == same) & (better.isNull() | (F.col("cost") < better))
    return p.withColumn("on_front", front).withColumn("cost", R6(F.col("cost")))


@query("""SELECT lang, count(*)::BIGINT AS n, round(count(*) FILTER (abs(h - j) <= 0.5) / count(*)::DOUBLE, 6) AS agreement, count(*) FILTER (abs(h - j) <= 0.5) / count(*)::DOUBLE >= 0.7::DOUBLE AS passes
    FROM (SELECT lang, doc_id % 3 / 2.0 AS h, quality / 1.0 AS j FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def q_judge_calibration(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    share = F.count_if(F.abs(F.col("doc_id") % 3 / 2 - F.col("quality")) <= 0.5) / F.count(F.lit(1))
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), R6(share).alias("agreement"), (share >= 0.7).alias("passes"))


@query(f"WITH {R} SELECT bench, round(stddev_pop(score), 6) AS sd_population, round(stddev_samp(score), 6) AS sd_sample FROM r GROUP BY 1")
def q_score_spread(spark, d):
    return run_records(spark, d).groupBy("bench").agg(R6(F.stddev_pop("score")).alias("sd_population"), R6(F.stddev_samp("score")).alias("sd_sample"))


@query(f"""WITH {R}, {CELLS} SELECT bench, config_id, seed, '| ' || bench || ' | ' || config_id || ' | ' || seed || ' | ' || n || ' | ' || input_tokens || ' | ' || obs_n || '/' || off_n || '/' || rec_n || ' |' AS line FROM c""")
def q_report_rows(spark, d):
    c = cells(spark, d)
    line = F.format_string("| %s | %s | %d | %d | %d | %d/%d/%d |", "bench", "config_id", "seed", "n", "input_tokens", "obs_n", "off_n", "rec_n")
    return c.select(*E.CELL, line.alias("line"))


@query(f"WITH {R} SELECT bench, count(DISTINCT task_id)::BIGINT AS items, count(DISTINCT strategy)::BIGINT AS strategies, count(*)::BIGINT AS rows_found, count(*) = count(DISTINCT task_id) * count(DISTINCT strategy) AS complete FROM r GROUP BY 1")
def q_completeness(spark, d):
    r = run_records(spark, d).groupBy("bench").agg(F.count_distinct("task_id").alias("items"), F.count_distinct("strategy").alias("strategies"), F.count(F.lit(1)).alias("rows_found"))
    return r.withColumn("complete", F.col("rows_found") == F.col("items") * F.col("strategies"))


@query(f"""WITH {R}, w AS (SELECT strategy, bench, avg(score) AS p, count(*) AS n FROM r GROUP BY 1, 2) SELECT strategy, bench, round(2 * 1.96::DOUBLE * sqrt(p * (1 - p) / n), 6) AS width, 2 * 1.96::DOUBLE * sqrt(p * (1 - p) / n) > 0.25::DOUBLE AS too_wide FROM w""")
def q_ci_width(spark, d):
    w = run_records(spark, d).groupBy("strategy", "bench").agg(F.avg("score").alias("p"), F.count(F.lit(1)).alias("n"))
    width = 2 * 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return w.select("strategy", "bench", R6(width).alias("width"), (width > 0.25).alias("too_wide"))


@query("""WITH k AS (SELECT doc_id, sha256(lang || '|' || coalesce(text, '')) AS key FROM documents), c AS (SELECT DISTINCT sha256(lang || '|' || coalesce(text, '')) AS key FROM documents WHERE doc_id % 3 = 0)
    SELECT k.doc_id, c.key IS NOT NULL AS hit FROM k LEFT JOIN c USING (key)""")
def q_cache_hit_miss(spark, d):
    key = F.sha2(F.concat("lang", F.lit("|"), F.coalesce("text", F.lit(""))), 256)
    k = table(spark, d, "documents").select("doc_id", key.alias("key"))
    cache = k.filter("doc_id % 3 = 0").select("key").distinct().withColumn("_h", F.lit(True))
    return k.join(cache, "key", "left").select("doc_id", F.coalesce("_h", F.lit(False)).alias("hit"))


@query(f"WITH {R} SELECT strategy, bench, seed, round(sum(cost_usd), 8) AS usd, round(sum(judge_cost_usd), 6) AS judge_usd, count(*)::BIGINT AS n FROM r WHERE strategy IN ('type_aware', 'task_aware') GROUP BY 1, 2, 3")
def q_cost_attribution(spark, d):
    r = run_records(spark, d).filter(F.col("strategy").isin("type_aware", "task_aware"))
    return r.groupBy("strategy", "bench", "seed").agg(F.round(F.sum("cost_usd"), 8).alias("usd"), R6(F.sum("judge_cost_usd")).alias("judge_usd"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {R}, {CELLS}, sm AS (SELECT bench, config_id, seed, n AS n_completed, accuracy AS mean FROM c WHERE seed = 0)
    SELECT c.bench, c.config_id, c.seed, coalesce(n_completed, n)::BIGINT AS n, coalesce(mean, 0) AS accuracy, CASE WHEN n_completed IS NULL THEN 'missing' ELSE 'complete' END AS status FROM c LEFT JOIN sm ON sm.bench = c.bench AND sm.config_id = c.config_id AND sm.seed = c.seed""")
def q_summary_fallback(spark, d):
    c = cells(spark, d)
    summary = c.filter("seed = 0").select(*E.CELL, F.col("n").alias("n_completed"), F.col("accuracy").alias("mean"))
    return c.join(summary, E.CELL, "left").select(
        *E.CELL, F.coalesce("n_completed", "n").alias("n"), F.coalesce("mean", F.lit(0.0)).alias("accuracy"), F.when(F.col("n_completed").isNull(), "missing").otherwise("complete").alias("status")
    )


@query(f"""WITH {R} SELECT bench, config_id, seed, task_id, row_number() OVER (PARTITION BY bench ORDER BY config_id, seed, task_id)::BIGINT AS position FROM r""")
def q_stable_orders(spark, d):
    w = Window.partitionBy("bench").orderBy("config_id", "seed", "task_id")
    return run_records(spark, d).select(*E.CELL, "task_id", F.row_number().over(w).cast("long").alias("position"))
