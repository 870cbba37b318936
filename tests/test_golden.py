"""Small cases with known answers, and invariants under reordering."""


import pytest
from pyspark.sql import functions as F

from trajet.functions import grading as G
from trajet.functions import text as T
from trajet.operators import classify, convert, evaluation, fixtures, groups, observations, pages, retail, windows

PART = "session_id long, msg_idx long, role string, part_type string, use_id string, tool_name string, bytes long, payload_len long, turn_index long"


def parts(spark, rows):
    """rows: (role, part_type, use_id, bytes, turn)"""
    return spark.createDataFrame([(1, i, r, p, u, "web_search", b, 0, t) for i, (r, p, u, b, t) in enumerate(rows)], PART)


def first(df):
    return df.collect()[0].asDict()


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_features(spark):
    use, res, usr = ("assistant", "tool_use"), ("tool", "tool_result"), ("user", "text")
    rows = [(*usr, None, 10, 0), (*use, "a", 10, 0), (*usr, None, 10, 1), (*usr, None, 10, 2), (*use, "b", 10, 3)]
    f = first(classify.features(parts(spark, rows)))
    assert f["turns_total"] == 4 and f["tool_call_density"] == 0.5
    f = first(classify.features(parts(spark, [(*usr, None, 1, 0), (*usr, None, 1, 5)])))
    assert f["turns_total"] == 6
    rows = [(*use, "a", 1, 0), (*use, "b", 1, 3), (*use, "c", 1, 4), (*res, "c", 8, 5)]
    f = first(classify.features(parts(spark, rows)))
    assert f["recent_tool_density"] == pytest.approx(2 / 3) and f["avg_tool_result_size"] == 8
    assert first(classify.classify(classify.features(parts(spark, [(*usr, None, 1, 0)]))))["class"] == "mixed"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("ccm", "ccc"), ("ccmm", "cccm"), ("cmtm", "cccc"), ("cmtt", "ccct"), ("m", "m"), ("cmcmm", "ccccm"),
    ],
)
def test_hysteresis(spark, raw, want):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(raw)], "session_id long, turn_index long, raw_class string")
    assert "".join(r["class"] for r in classify.hysteresis(df).orderBy("turn_index").collect()) == want


def test_dispatch(spark):
    df = spark.createDataFrame([("conversational",), ("tool_heavy",), ("mixed",)], "class string")
    got = {r["class"]: (r["run_observer"], r["run_offloader"]) for r in classify.dispatch(df).collect()}
    assert got == {"conversational": (True, False), "tool_heavy": (False, True), "mixed": (True, True)}
    with pytest.raises(ValueError):
        classify.dispatch(df, classifier=False)


def offloaded(spark, sizes, **kw):
    rows = [x for i, s in enumerate(sizes) for x in [("assistant", "tool_use", f"t{i}", 10, 0), ("tool", "tool_result", f"t{i}", s, 0)]]
    p = groups.pairs(parts(spark, rows)).filter("kind = 'group'")
    return [r["offloaded"] for r in groups.offload(p, **kw).orderBy("result_idx").collect()]


def test_offload(spark):
    assert offloaded(spark, [5000, 5000]) == [False, False]  # the last two stay
    assert offloaded(spark, [4096, 4097, 1, 1]) == [False, True, False, False]  # strictly larger
    assert offloaded(spark, [4000] * 9) == [False] * 6 + [True] + [False] * 2  # 24000 kept, then over
    assert offloaded(spark, [3000, 3000, 1, 1], t_size=2048) == [True, True, False, False]


def test_pairs(spark):
    rows = [("assistant", "tool_use", "a", 1, 0), ("tool", "tool_result", "a", 1, 0), ("assistant", "tool_use", "b", 1, 1), ("tool", "tool_result", "z", 1, 1), ("assistant", "tool_use", "a", 1, 2)]
    got = {(r["use_id"], r["kind"], r["use_idx"]) for r in groups.pairs(parts(spark, rows)).collect()}
    assert got == {("a", "group", 4), ("b", "inflight", 2), ("z", "orphan", None)}
    assert value(spark, T.group_id(F.lit("a"), F.lit(0))) == __import__("hashlib").sha256(b"a:0").hexdigest()[:16]


def messages(spark, tokens, roles=None):
    return spark.createDataFrame([(1, i, (roles or "u" * len(tokens))[i].replace("u", "user").replace("s", "system"), "x" * 4 * t, t) for i, t in enumerate(tokens)], "session_id long, msg_idx long, role string, text string, tokens long")


def idx(df):
    return sorted(r["msg_idx"] for r in df.collect())


def test_windows_at_their_boundaries(spark):
    m = messages(spark, [10, 10, 10, 10])
    assert idx(windows.tail_budget(m, 20)) == [2, 3] and idx(windows.tail_budget(m, 21)) == [1, 2, 3]
    assert idx(windows.tail_clip(m, 20)) == [2, 3] and idx(windows.tail_clip(m, 5)) == [3]
    n = windows.naive_truncation(messages(spark, [5, 10, 10, 10], "suuu"), 24)
    assert idx(n) == [-1, 0, 3] and "2 turns" in n.filter("msg_idx = -1").first()["text"]
    seed = spark.createDataFrame([(1, 4)], "session_id long, start long")
    g = spark.createDataFrame([(1, 3, 5), (1, 1, 3), (1, 0, 2)], "session_id long, use_idx long, result_idx long")
    assert windows.pair_start(seed, g).first()["start"] == 0
    obs = spark.createDataFrame([(1, 1)], "session_id long, last_observed_turn long")
    t = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, None)], "session_id long, msg_idx long, turn_index long")
    assert idx(windows.watermark(t, obs)) == [1, 2]


def test_observations(spark):
    text = "- 2024-03-15 (high) a fact\n  - detail one\n  - detail two\n\n- 2024/03/16 (med) b\n- 1700000000 (low) c\n- 2024-03-17 (sure) d\nnoise"
    df = spark.createDataFrame([(1, 7, text)], "session_id long, source_turn long, text string")
    rows = observations.parse(df).orderBy("seq").collect()
    good = [(r["timestamp"], r["confidence"], r["statement"], r["n_details"]) for r in rows if r["reason"] is None]
    assert good == [(1710460800, "high", "a fact", 2), (1710547200, "med", "b", 0), (1700000000, "low", "c", 0)]
    assert [r["statement"] for r in rows if r["reason"]] == ["- 2024-03-17 (sure) d"]
    assert observations.note(observations.parse(df)).first()["note"].splitlines()[1] == "- obs#1 ts=1700000000 (low) c"


@pytest.mark.parametrize(
    "answer, truth, ok",
    [
        ("17 apples", "17", True), ("$1,234", "1234", True), ("abc", "17", False), ("5%", "5", True), ("a, b", "b, a", False), ("A; 2.0", "a, 2", True),
        ("a, b, c", "a, b", False), ("The Cat!", "the cat", True), ("dog", "cat", False), ("1e3", "1000", True),
    ],
)
def test_scorer(spark, answer, truth, ok):
    assert value(spark, G.grade(F.lit(answer), F.lit(truth))) is ok


def test_final_answer_and_judges(spark):
    fa = lambda s: value(spark, G.final_answer(F.lit(s)))
    assert fa("x Final answer: a Final answer: b ") == "b" and fa("Final answer: a. Final answer:** 7") == "7" and fa(" plain ") == "plain"
    assert value(spark, G.yes_no(F.lit("Yes."))) is True and value(spark, G.yes_no(F.lit("nothing"))) is None
    assert value(spark, G.three_level(F.lit('so {"score": 1} ok'))) == 1.0 and value(spark, G.three_level(F.lit('{"score": 0.3}'))) is None
    long = "x" * 1000
    assert value(spark, T.rule_digest(F.lit(long))) == "x" * 300 + T.TRUNCATION_MARKER + "x" * 300
    assert value(spark, T.rule_digest(F.lit("y" * 613))) == "y" * 613
    assert value(spark, T.canonical_json(F.lit('{"b": 1, "a": {"d": [1, null], "c": "é"}}'))) == '{"a":{"c":"é","d":[1,null]},"b":1}'


def test_rewards(spark):
    actual = spark.createDataFrame([(1, "pending", [3, 2, 2]), (2, "cancelled", [5])], "order_id long, status string, items array<long>")
    expected = spark.createDataFrame([(1, None, [2, 3]), (2, "cancelled", None), (3, None, None), (1, "delivered", None), (2, None, [5, 6])], "order_id long, status string, items array<long>")
    assert sorted((r["order_id"], r["reward"]) for r in retail.order_reward(actual, expected).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]
    diff = retail.env_diff(actual.select("order_id", "status"), spark.createDataFrame([(1, "pending"), (4, "x")], "order_id long, status string"), "order_id")
    assert {(r["order_id"], r["change"]) for r in diff.collect()} == {(2, "removed"), (4, "added")}


def test_statistics(spark):
    same = spark.createDataFrame([(i, 0.0) for i in range(20)], "task_id long, diff double")
    r = first(evaluation.permutation_test(same, 100))
    assert r["p_value"] == 1 and r["delta"] == 0
    ones = spark.createDataFrame([(i, 1.0) for i in range(20)], "task_id long, diff double")
    r = first(evaluation.permutation_test(ones, 200))
    assert r["p_value"] < 0.01 and r["delta"] == 1
    lo, hi = (value(spark, c) for c in evaluation.wilson(F.lit(0.0), F.lit(10.0)))
    assert lo == 0 and 0.2 < hi < 0.35
    b = first(evaluation.bootstrap(spark.createDataFrame([(1.0,)] * 30 + [(0.0,)] * 10, "score double"), 200))
    assert b["lo"] < 0.75 < b["hi"] and b["accuracy"] == 0.75
    p = spark.createDataFrame([("a", float(x)) for x in (5, 1, 9, 3)], "k string, v double")
    r = first(evaluation.percentiles(p, "k", "v"))
    assert (r["p50"], r["p95"], r["median"]) == (5.0, 9.0, 4.0)  # round(1.5) is 2
    sample = evaluation.stratified(spark.createDataFrame([(i, "abc"[i % 3] if i < 30 else "a") for i in range(40)], "id long, k string"), "k", "id", 8)
    assert sorted((r["k"], r["count"]) for r in sample.groupBy("k").count().collect()) == [("a", 4), ("b", 2), ("c", 2)]


def test_breaker_is_strict(spark):
    costs = lambda c: spark.createDataFrame([(i, c) for i in range(25)], "i long, cost double")
    halted = lambda c: [r["halted"] for r in evaluation.breaker(costs(c), ["i"], "cost", 100, 100.0).orderBy("i").collect()]
    assert not any(halted(1.5)) and halted(1.51) == [False] * 19 + [True] * 6


def test_breaker_halts_each_sweep_over_many_ranges(spark):
    rows = [(s, i, None if i % 11 == 0 else cost * (1 + i % 5)) for s, cost, n in (("a", 0.125, 900), ("b", 0.75, 700), (None, 0.375, 40), ("d", 9.0, 19)) for i in range(n)]
    rows += [("e", i, 0.125 if i < 300 else 3.0) for i in range(1200)]
    expected, seen = {}, {}
    for s, i, cost in rows:
        n, costs, spent, halted = seen.get(s, (0, 0, 0.0, False))
        n, costs, spent = n + 1, costs + (cost is not None), spent + (cost or 0)
        halted = halted or n >= 20 and costs > 0 and spent / costs * 100 > 1.5 * 100
        seen[s] = n, costs, spent, halted
        expected[s, i] = halted
    df = spark.createDataFrame(rows, "sweep string, i long, cost double").repartition(7)
    out = evaluation.breaker(df, ["i"], "cost", 100, 100.0, by=["sweep"])
    assert out.columns == ["sweep", "i", "cost", "halted"]
    assert {(r["sweep"], r["i"]): bool(r["halted"]) for r in out.collect()} == expected
    assert 0 < sum(expected.values()) < len(rows)


def test_mode_ties_go_by_name(spark):
    df = spark.createDataFrame([(1, [("mixed",), ("tool_heavy",), ("tool_heavy",), ("mixed",)]), (2, [])], "task_id long, turns array<struct<class_signal:string>>")
    assert {r["task_id"]: r["class"] for r in evaluation.mode_class(df).collect()} == {1: "mixed", 2: None}


def test_pages():
    html = "<html><head><title>T &amp; t</title><script>no</script></head><body><nav><p>menu</p></nav><h1>Head</h1><ul><li>one <p>two</p></li></ul></body></html>"
    assert pages.extract(html) == ("T & t", "Head\n\none two\n\ntwo")
    assert pages.extract("plain <b>text</b>") == ("", "plain text")
    assert len(pages.extract("<p>" + "x" * 60_000 + "</p>")[1]) < 50_100


def test_fixture_replay(spark):
    calls = spark.createDataFrame([(1, i, "s", a) for i, a in enumerate("abxbc")], "session_id long, seq long, tool_name string, args string")
    fx = spark.createDataFrame([("s", "exact", "x", 0, "X"), ("s", "first", None, 0, "A"), ("s", "first", None, 1, "B")], "tool_name string, kind string, args string, slot int, output string")
    got = [(r["matched_by"], r["output"]) for r in fixtures.replay(calls, fx).orderBy("seq").collect()]
    assert got == [("first", "A"), ("first", "B"), ("exact", "X"), ("none", None), ("none", None)]


def test_conversion(spark):
    part = "array<struct<type:string,text:string,id:string,name:string>>"
    df = spark.createDataFrame(
        [(1, "assistant", [("reasoning", "r", None, None), ("approval", None, "1", None), ("tool-call", None, "1", "s")]), (2, "system", [("text", "a", None, None), ("text", "b", None, None)]), (3, "tool", [("tool-denied", "x", "1", "s"), ("text", "y", None, None)])],
        f"i long, role string, content {part}",
    )
    core = {r["i"]: [(p["type"], p["text"]) for p in r["content"]] for r in convert.to_core(df).collect()}
    assert core == {1: [("text", "r"), ("tool_use", None)], 2: [("text", "a"), ("text", "b")], 3: [("tool_result", "[denied]"), ("text", "y")]}
    back = {r["i"]: [(p["type"], p["text"]) for p in r["content"]] for r in convert.to_sdk(convert.to_core(df)).collect()}
    assert back == {1: [("text", "r"), ("tool-call", None)], 2: [("text", "a\nb")], 3: [("tool-result", "[denied]")]}


def test_row_order_and_partitions_do_not_matter(spark):
    rows = [("user", "text", None, 10 * i, i // 3) for i in range(12)] + [("assistant", "tool_use", f"t{i}", 9, i) for i in range(4)] + [("tool", "tool_result", f"t{i}", 5000, i) for i in range(4)]
    df = parts(spark, rows)
    key = lambda x: sorted(map(str, x.collect()))
    for op in (classify.features, lambda p: groups.offload(groups.pairs(p).filter("kind = 'group'")), classify.prefix_classes):
        assert len({tuple(key(op(x))) for x in (df, df.orderBy(F.desc("msg_idx")), df.repartition(7))}) == 1
