"""The run store's round trips, and streams against their batch forms."""

import json
import time

import pytest
from pyspark.sql import functions as F

from trajet.operators import classify
from trajet.sources import runs, schemas
from trajet.streaming import state


def record(task, seed=0, **kw):
    return {"run_id": "r", "bench": "b", "config_id": "c", "seed": seed, "task_id": task, "score": {"primary": 1.0, "secondary": {"x": 0.5}}, "totals": {"input": 10, "output": 2}, "cost_usd": 0.5, "turns": [], "errors": []} | kw


def test_records(spark, tmp_path):
    root = str(tmp_path / "runs")
    assert runs.read_records(spark, root).count() == 0 and runs.cell_paths(spark, root).count() == 0
    df = spark.createDataFrame([json.dumps(record(t)) for t in "ab"], "string").select(F.from_json("value", schemas.RUN_RECORD).alias("r")).select("r.*")
    assert runs.append_pending(df, root) == 2 and runs.append_pending(df, root) == 0
    more = df.withColumn("task_id", F.concat("task_id", F.lit("2"))).unionByName(df)
    assert runs.append_pending(more, root) == 2
    with open(f"{root}/bench=b/config_id=c/seed=0/extra.json", "w") as f:
        f.write('\n{"task_id": "ok"}\n{broken\n')
    got = runs.read_records(spark, root)
    assert sorted(r["task_id"] for r in got.select("task_id").collect()) == ["a", "a2", "b", "b2", "ok"]
    assert runs.count_malformed(spark, root) == 1
    s = runs.summaries(got.filter("task_id <> 'ok'")).first()
    assert s["n_completed"] == 4 and s["mean_primary_score"] == 1 and s["total_cost_usd"] == 2
    runs.write_documents(runs.summaries(got), str(tmp_path / "summary"))
    assert runs.read_summaries(spark, str(tmp_path / "summary")).count() == 1
    assert runs.read_summaries(spark, str(tmp_path / "none")).count() == 0


def test_cell_paths(spark, tmp_path):
    for p in ("b1/c1/0", "b1/c1/x", "b1/c2/7"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "records.ndjson").write_text("{}\n")
    (tmp_path / "b2/c1/1").mkdir(parents=True)
    got = {(r["bench"], r["config_id"], r["seed"]) for r in runs.cell_paths(spark, str(tmp_path)).collect()}
    assert got == {("b1", "c1", 0), ("b1", "c2", 7)}


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x", "n": 1}, {"id": "y", "n": 2}]')
    (tmp_path / "b.json").write_text('{"z": {"id": "z", "n": 3}}')
    got = runs.read_either_form(spark, str(tmp_path), "id")
    assert {(r[0], r[1]) for r in got.select("key", F.variant_get("row", "$.n", "int")).collect()} == {("x", 1), ("y", 2), ("z", 3)}
    (tmp_path / "tasks").mkdir()
    (tmp_path / "tasks/1.json").write_text('{\n"idx": 1,\n"question": "q", "answer": "", "level": "1", "has_file": false}')
    tasks = runs.read_json_folder(spark, str(tmp_path / "tasks"), schemas.FILE_QA_TASK)
    good, bad = runs.validated(tasks, {"answer is empty": "length(answer) > 0", "level is known": "level in ('1', '2', '3')"})
    assert good.count() == 0 and bad.first()["broken"] == ["answer is empty"]


def test_cached_calls(spark):
    req = spark.createDataFrame([("a",), ("b",)], "key string")
    cache = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("c", 0.0)], "key string, score double")
    hits, misses = runs.cached_calls(req, cache)
    assert [tuple(r) for r in hits.collect()] == [("a", 1.0)] and [r[0] for r in misses.collect()] == ["b"]


def read_all(query, n, patience=90):
    """Waits until the query has read n rows. A query with timers never runs out of batches, so it cannot be asked for all available."""
    until = time.time() + patience
    while sum(p["numInputRows"] for p in query.recentProgress) < n:
        if query.exception() or time.time() > until:
            raise RuntimeError(f"{query.exception()}: {query.lastProgress}")
        time.sleep(0.1)


def stream(spark, df, path, op, mode="append"):
    """The rows in two files, one a batch."""
    n = df.count()
    for i in range(2):
        part = df.filter(F.col("n") % 2 == i) if n < 0 else df.filter((F.col("n") >= n // 2 * i) & (F.col("n") < (n // 2 if i == 0 else n)))
        part.coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = op(src).writeStream.outputMode(mode).format("memory").queryName("out").start()
    read_all(q, n)
    q.stop()
    return spark.table("out")


def test_hysteresis_stream_equals_batch(spark, tmp_path):
    raw = "cmmcttmcmcccttctm"
    rows = [(i * 3 + s, s, i, raw[(i + s) % len(raw)]) for i in range(20) for s in range(3)]
    df = spark.createDataFrame(rows, "n long, session_id long, turn_index long, raw_class string")
    got = stream(spark, df, str(tmp_path / "s"), state.hysteresis_stream)
    key = lambda x: sorted(map(tuple, x.select("session_id", "turn_index", "raw_class", "class").collect()))
    assert key(got) == key(classify.hysteresis(df))


def test_rate_limits(spark, tmp_path):
    allowed, kept = state.limit_calls([0, 1, 2, 3, 300, 301.5], 300, 3)
    assert allowed == [True, True, True, False, True, True] and kept == [2, 300, 301.5]
    rows = [(i, i % 2, i, float(i * 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "n long, session_id long, event_id long, t double")
    got = stream(spark, df, str(tmp_path / "r"), lambda s: state.rate_limit_stream(s, 100, 5))
    batch = state.rate_limited(df.withColumn("ts", F.col("t").cast("timestamp")), 100, 5)
    key = lambda x: sorted(map(tuple, x.select("session_id", "event_id", "allowed").collect()))
    assert key(got) == key(batch)


def test_scratchpad_and_sessions(spark, tmp_path):
    rows = [(i, 1, t, 10) for i, t in enumerate([0, 60, 120, 9000, 9001, 9002])]
    df = spark.createDataFrame(rows, "n long, session_id long, t long, size long").withColumn("ts", F.timestamp_seconds("t"))
    last = stream(spark, df, str(tmp_path / "p"), state.scratchpad_stream, "update").collect()[-1]
    assert (last["entries"], last["bytes"]) == (3, 30)
    ev = df.select("n", F.col("session_id").alias("user_id"), "ts")
    got = stream(spark, ev, str(tmp_path / "w"), state.idle_sessions, "complete").collect()
    assert sorted(r["n"] for r in got) == [3, 3]


@pytest.mark.parametrize("schema", [v for k, v in vars(schemas).items() if k.isupper() and not v.startswith("struct")])
def test_schemas_parse(spark, schema):
    assert spark.createDataFrame([], schema).count() == 0
