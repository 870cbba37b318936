"""Retail tools with their errors, summary and judge checks, calibration, events, files, observation state."""

import datetime

import pytest
from pyspark.sql import functions as F
from test_sources_streaming import stream

from trajet.functions import text as T
from trajet.operators import evaluation, retail, traces
from trajet.sources import runs
from trajet.streaming import state


def test_retail_tools(spark):
    orders = spark.createDataFrame([(1, "delivered"), (2, "pending")], "order_id long, status string")
    items = spark.createDataFrame([(1, 7, 2.0), (1, 7, 3.0), (1, 8, 10.0)], "order_id long, item_id long, price double")
    ask = lambda rows: {r["order_id"]: (r["refund"], r["n_items"], r["error"]) for r in retail.return_items(orders, items, spark.createDataFrame(rows, "order_id long, item_id long")).collect()}
    assert ask([(1, 7), (1, 7), (2, 7), (3, 1)]) == {1: (5.0, 2, None), 2: (None, None, "order 2 not delivered (status=pending)"), 3: (None, None, "order not found: 3")}
    assert ask([(1, 7), (1, 9)]) == {1: (None, None, "item_id 9 not in order")}
    req = spark.createDataFrame([(1, "a", "b", "c"), (2, "a", "b", "c"), (5, "a", "b", "c")], "order_id long, address1 string, city string, zip string")
    got = {r["order_id"]: (r["new_address"] and r["new_address"]["city"], r["error"]) for r in retail.change_address(orders, req).collect()}
    assert got == {1: (None, "order 1 not pending (status=delivered)"), 2: ("b", None), 5: (None, "order not found: 5")}
    pending = spark.createDataFrame([(1, "pending", 9.0), (2, "delivered", 4.0)], "order_id long, status string, paid double")
    assert {tuple(r) for r in retail.cancel(pending).collect()} == {(1, "cancelled", 9.0, None), (2, "delivered", 0.0, "order 2 not pending (status=delivered)")}


def test_run_checks(spark):
    cells = spark.createDataFrame([("b", "c", 0), ("b", "c", 1), ("b", "c", 2)], "bench string, config_id string, seed int")
    summaries = spark.createDataFrame([("b", "c", 0, 0, "partial"), ("b", "c", 1, 3, "complete")], "bench string, config_id string, seed int, n_completed long, status string")
    got = {(r["path"], r["check"]) for r in evaluation.summary_issues(cells, summaries).collect()}
    assert got == {("b/c/0", "nothing completed"), ("b/c/0", "partial"), ("b/c/2", "summary missing")}
    rec = spark.createDataFrame([("b", "1", None, None), ("b", "2", None, "said"), ("b", "3", 0.0, None), ("b", "4", -1.0, "judge-stub"), ("x", "5", None, None)], "bench string, task_id string, judge_cost_usd double, judge_explanation string")
    assert {r["task_id"] for r in evaluation.judge_issues(rec, ["b"]).collect()} == {"1", "4"}
    tr = spark.createDataFrame([(1, 10, True), (2, 20, False), (3, 30, True)], "trace_id long, size long, useful boolean")
    assert {(r["threshold"], r["on_front"]) for r in evaluation.calibrate(tr, [5.0, 15.0, 17.0, 40.0]).collect()} == {(5.0, True), (15.0, True), (17.0, True), (40.0, True)}
    tr = spark.createDataFrame([(1, 10, True), (2, 0, False)], "trace_id long, size long, useful boolean")
    assert {(r["threshold"], r["on_front"]) for r in evaluation.calibrate(tr, [-1.0, 5.0, 20.0]).collect()} == {(-1.0, True), (5.0, True), (20.0, True)}


@pytest.mark.parametrize("n_err, total, want", [(1, 4, True), (1, 20, False), (1, 10, True)])
def test_error_gate(spark, n_err, total, want):
    none = "array<struct<recall_events:array<string>,compaction_events:array<struct<type:string>>>>"
    rows = [("b", "c", 0, i, 10, 5, 0.1, float(i % 2), int(i < n_err), []) for i in range(total)]
    df = spark.createDataFrame(rows, f"bench string, config_id string, seed int, task_id long, input_tokens long, output_tokens long, cost_usd double, score double, n_errors long, turns {none}")
    assert ("error rate" in {r["check"] for r in evaluation.issues(df).collect()}) is want


def test_bad_records(spark):
    none = "array<struct<recall_events:array<string>,compaction_events:array<struct<type:string>>>>"
    rows = [("b", "c", 0, 1, 0, 0, float("nan"), float("nan"), 0, []), ("b", "c", 0, 2, 1, 0, 0.0, 1.0, 0, []), ("b", "c", 0, 3, 1, 0, -1.0, None, 0, [])]
    df = spark.createDataFrame(rows, f"bench string, config_id string, seed int, task_id long, input_tokens long, output_tokens long, cost_usd double, score double, n_errors long, turns {none}")
    got = {(r["path"].split("#")[-1], r["check"]) for r in evaluation.issues(df).collect() if "#" in r["path"]}
    assert got == {("1", "no tokens"), ("1", "cost not finite or negative"), ("1", "score not finite"), ("2", "cost is zero"), ("3", "cost not finite or negative"), ("3", "score not finite")}


def test_events_and_dates(spark):
    schema = "session_id long, seq long, kind string, type string, turn_index int, before_bytes long, after_bytes long, llm_cost_usd double, recall_id string, tool_name string, reason string, class string, confidence double"
    rows = [(1, 0, "classifier_signal", None, 3, None, None, None, None, None, None, "mixed", 0.5), (1, 1, "compaction", "offload", 3, 10, 2, None, None, None, None, None, None)]
    got = [(r["kind"], r["payload"]) for r in traces.instrumentation(spark.createDataFrame(rows, schema)).orderBy("seq").collect()]
    assert got == [("class_signal", '{"turn_index":3,"class":"mixed","confidence":0.5}'), ("compaction", '{"type":"offload","turn_index":3,"before_bytes":10,"after_bytes":2}')]
    v = lambda n: spark.range(1).select(T.prompt_date(F.lit(n).cast("long"))).first()[0]
    assert v(1701302400) == "2023-11-30" and v(1701302400000) == "2023-11-30" and v(5) == "1970-01-01"
    assert spark.range(1).select(T.prefix_bytes(F.lit('{"b":1, "a":"é"}'))).first()[0] == len('{"a":"é","b":1}'.encode())


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x" * 50)
    (tmp_path / "b.txt").write_bytes(b"y" * 5)
    assert sorted((bytes(r["content"]), r["cut"]) for r in runs.read_capped(spark, str(tmp_path), 10).collect()) == [(b"x" * 10, True), (b"y" * 5, False)]
    later = datetime.datetime.now(datetime.UTC).replace(tzinfo=None) + datetime.timedelta(hours=2)
    assert runs.stale_files(spark, str(tmp_path), str(later), 3600).count() == 2 and runs.stale_files(spark, str(tmp_path), str(later), 36_000).count() == 0
    cells = spark.createDataFrame([("b", "h1", 0), ("b", "plain", 0)], "bench string, config_id string, seed int")
    meta = spark.createDataFrame([("b", "h1", 0, "named")], "bench string, config_id string, seed int, config_name string")
    assert {r["config_name"] for r in runs.named_cells(cells, meta).collect()} == {"named", "plain"}


def test_tier2_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, 1, i, i, "s" if i % 2 else None) for i in range(8)], "n long, session_id long, seq long, turn_index long, statement string")
    last = max(tuple(r) for r in stream(spark, df, str(tmp_path / "t2"), state.tier2_stream, "update").collect())
    assert last == (1, 4, 7)
