"""Importers, validation, prompts, observers and traces on small cases."""

import base64

from pyspark.sql import functions as F

from trajet.operators import corpora as C
from trajet.operators import observe, traces


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_sessions_by_number(spark):
    conv = '{"session_10": [{"speaker": "A", "text": "late"}], "session_2": [{"speaker": "B", "text": "early"}], "session_2_date_time": "1 May", "session_x": 3, "session_0": [], "speaker_a": "A"}'
    df = spark.createDataFrame([("s", conv)], "sample_id string, j string").select("sample_id", F.parse_json("j").alias("conversation"))
    assert C.sessions_text(C.sessions_of(df)).first()["text"] == "[session_2 | 1 May]\n[1 May] B: early\n\n[session_10]\nA: late\n"


def test_placeholders_and_links(spark):
    part = "array<struct<type:string,text:string,path:string,alt:string>>"
    df = spark.createDataFrame([([("text", "a", None, None), ("image", None, "x.png", "cat"), ("file", None, "y.pdf", None), ("tool_use", None, None, None)],), ([],)], f"content {part}")
    assert [r[0] for r in df.select(C.text_only(F.col("content"))).collect()] == [["a", "[Image attachment: x.png; alt=cat]", "[File attachment: y.pdf]"], [""]]
    links, rest = C.image_links(F.lit("see http://a.b/c.PNG?x=1 and http://a.b/d.txt or https://q/e.jpeg"))
    assert value(spark, links) == ["http://a.b/c.PNG?x=1", "https://q/e.jpeg"]
    assert value(spark, rest) == "see and http://a.b/d.txt or"


def test_ids_and_top_up(spark):
    used = spark.createDataFrame([("qa", 4), ("qa", 7)], "category string, number int")
    tasks = spark.createDataFrame([("qa", "b"), ("qa", "a"), ("qa", "a"), ("qa", "c"), ("code", "z")], "category string, source_id string")
    got = {(r["source_id"], r["task_id"]) for r in C.allocate_ids(tasks, used, 4).collect()}
    assert got == {("a", "at_qa_008"), ("b", "at_qa_009"), ("z", "at_code_001")}
    wanted = spark.createDataFrame([("qa", 4), ("code", 1), ("mixed", 1)], "category string, target int")
    assert sorted((r["category"], r["k"]) for r in C.top_up(tasks, wanted).collect()) == [("mixed", 1)]


def test_validation(spark):
    required = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t2", "a")], "task_id string, tool_name string")
    offered = spark.createDataFrame([("t1", "a")], "task_id string, tool_name string")
    assert {(r["task_id"], r["reason"]) for r in C.palette_violations(required, offered).collect()} == {("t1", "required tool not offered: b"), ("t2", "tools_available is empty")}
    nodes = spark.createDataFrame([("t", 1, None, "composite"), ("t", 2, 1, "composite"), ("u", 1, None, "exact")], "task_id string, node_id int, parent_id int, strategy string")
    assert [(r["task_id"], r["node_id"]) for r in C.composite_violations(nodes).collect()] == [("t", 2)]
    tree = [("t", 1, None, 0, "mean", None), ("t", 2, 1, 1, "all", None), ("t", 3, 1, 1, None, 0.5), ("t", 4, 2, 2, None, 1.0), ("t", 5, 2, 2, None, 1.0), ("u", 1, None, 0, "any", None), ("u", 2, 1, 1, None, 0.5)]
    df = spark.createDataFrame(tree, "task_id string, node_id int, parent_id int, level int, rule string, score double")
    assert {(r["task_id"], r["score"]) for r in C.composite_scores(df, 2).collect()} == {("t", 0.75), ("u", 0.0)}


def test_bake(spark):
    fx = spark.createDataFrame([("t", 0, "old", False), ("t", 1, "hole", True), ("t", 2, "hole", True)], "task_id string, position int, output string, needs_bake boolean")
    new = spark.createDataFrame([("t", 0, "no"), ("t", 1, "new")], "task_id string, position int, output string")
    assert [(r["output"], r["needs_bake"], r["baked"]) for r in C.bake(fx, new).orderBy("position").collect()] == [("old", False, False), ("new", False, True), ("hole", True, False)]


def test_prompt_parts(spark):
    m = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "system", "S"), (1, 2, "user", "x"), (2, 0, "user", "y")], "session_id long, msg_idx long, role string, text string")
    got = [(r["session_id"], r["position"], r["text"]) for r in C.recall_note(m, "N").orderBy("session_id", "position").collect()]
    assert got == [(1, 0, "hi"), (1, 1, "S"), (1, 2, "N"), (1, 3, "x"), (2, 0, "y")]
    parts = spark.createDataFrame([(1, 0, 0, "system"), (1, 1, 0, "user"), (1, 1, 1, "user"), (1, 2, 0, "user")], "session_id long, msg_idx long, part_idx int, role string")
    assert [(r["msg_idx"], r["part_idx"]) for r in C.cache_marks(parts).filter("cache_mark").collect()] == [(1, 1)]
    tools = F.array(F.struct(F.lit("t").alias("name"), F.lit("does it").alias("line")))
    text = value(spark, C.system_prompt("HEAD", "STYLE", "POLICY", F.lit("  "), tools))
    assert text == "HEAD\n\n# Available tools\n\nYou have 1 tool.\n\n- **t** — does it\n\nPOLICY\n\nSTYLE"
    listed = spark.createDataFrame([(1, "recall_tool_full"), (2, "x")], "session_id long, name string")
    held = spark.createDataFrame([(1, 3), (2, 0)], "session_id long, entries int")
    assert {(r["session_id"], r["name"]) for r in C.inject_recall(listed, held, True).collect()} == {(1, "recall_tool_full"), (1, "recall_tool_summary"), (2, "x")}
    assert C.inject_recall(listed, held, False).count() == 2
    assert value(spark, C.result_list(C.mock_search(F.lit("q"), 1))) == "Top 1 results:\n1. Result 1 for q\n   https://example.com/1\n   About q"
    assert value(spark, C.data_url(F.lit("a/B.PNG"), F.lit(b"\x00\x01"))) == "data:image/png;base64," + base64.b64encode(b"\x00\x01").decode()
    tasks = spark.createDataFrame([(["a", "b"],)], "items array<string>")
    assert [r["task"] for r in C.pick_by_index(spark.createDataFrame([(1,), (5,)], "task_idx int"), tasks).collect()] == ["b"]


def messages(spark, n=6):
    return spark.createDataFrame([(s, i, "user", "x" * 40, 10) for s in (1, 2) for i in range(n if s == 1 else 1)], "session_id long, msg_idx long, role string, text string, tokens long")


def test_observer(spark):
    m = messages(spark)
    report, found, left = observe.observe(m, 50)
    assert {r["session_id"]: r["reason"] for r in report.collect()} == {1: "no_llm_caller", 2: "below_threshold"} and left.count() == 7 and found.count() == 0
    report, found, left = observe.observe(m, 50, observe.stub_caller)
    assert {r["session_id"]: (r["ran"], r["extracted"]) for r in report.collect()} == {1: (True, 1), 2: (False, 0)}
    assert found.count() == 1 and sorted((r["session_id"], r["msg_idx"]) for r in left.collect()) == [(1, 5), (2, 0)]
    silent = lambda p: F.lit("nothing")
    assert observe.observe(m, 50, silent)[2].count() == 7 and observe.observe(m, 50, silent, parity=True)[2].count() == 2
    bad = lambda p: F.lit("- 2024-01-01 (sure) x")
    report, found, left = observe.observe(m, 50, bad)
    assert report.filter("session_id = 1").first()["reason"] == "parse_error" and found.count() == 0 and left.count() == 7
    again = observe.reflect(observe.observe(m, 50, observe.stub_caller)[1], 1, observe.stub_caller)
    assert again.count() == 1 and again.first()["source_turn"] == 5
    assert observe.task_aware(m, F.lit("q")).count() == 2


def test_clip_window(spark):
    m = messages(spark).filter("session_id = 1")
    g = spark.createDataFrame([(1, 2, 5), (1, 0, 3)], "session_id long, use_idx long, result_idx long")
    none = spark.createDataFrame([], "session_id long, use_idx long")
    idx = lambda x: sorted(r["msg_idx"] for r in x.collect())
    assert idx(observe.clip_window(m, g, none, 10)) == [2, 3, 4, 5]
    assert idx(observe.clip_window(m, g, spark.createDataFrame([(1, 1)], "session_id long, use_idx long"), 10)) == [1, 2, 3, 4, 5]


def test_traces(spark):
    rows = [("s", "1", None, "eval.task", "TRACE"), ("s", "1", "1", "eval.turn", "SPAN"), ("s", "1", "1", "web_search", "TOOL"), ("s", "2", "1", "x", "TRACE"), ("s2", "3", None, "y", "TRACE")]
    df = spark.createDataFrame(rows, "session_id string, trace_id string, parent_id string, name string, type string")
    got = {r["session_id"]: tuple(r)[1:] for r in traces.hierarchy(df).collect()}
    assert got == {"s": (2, 1, 1, 1, 1), "s2": (1, 1, 0, 0, 0)}
    assert traces.match_sessions(df, "s", prefix=True).count() == 5 and traces.match_sessions(df, "s").count() == 4
