"""Event output beside results, exactly once, and streams that stop on cost."""

from collections import Counter

import pytest

from trajet.operators import evaluation as E
from trajet.sources.schemas import RUN_RECORD
from trajet.streaming import outputs as O


def record(i, cost=1.0, turns=()):
    return {"bench": "b", "config_id": "c", "seed": 1, "task_id": f"t{i:03}", "cost_usd": cost, "turns": list(turns)}


TURNS = [
    {"turn_index": 0, "class_signal": {"class": "mixed", "confidence": 0.5}, "recall_events": [{"recall_id": "r1", "turn_index": 0}], "compaction_events": [{"type": "offload", "turn_index": 0, "before_bytes": 9}, {"type": "observer", "turn_index": 0}]},
    {"turn_index": 1},
]


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, RUN_RECORD).coalesce(1).write.mode("append").json(str(folder / name))


def stream(spark, folder):
    return spark.readStream.schema(RUN_RECORD).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder / "*"))


def batches(spark, folder, costs):
    """One file for each list of costs, older first."""
    import os

    i = 0
    for k, group in enumerate(costs):
        put(spark, folder, f"{k:02}", [record(i + j, c, TURNS if (i + j) % 2 else ()) for j, c in enumerate(group)])
        for f in (folder / f"{k:02}").iterdir():
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
        i += len(group)


def rows(spark, path):
    return spark.read.json(str(path)).collect()


def test_events_of_records(spark):
    df = spark.createDataFrame([record(1, 1.0, TURNS), record(2)], RUN_RECORD)
    got = sorted(((r["task_id"], r["turn_index"], r["position"], r["kind"], r["payload"]) for r in O.side_events(df).collect()))
    assert [(t, k) for t, _, _, k, _ in got] == [("t001", "compaction"), ("t001", "compaction"), ("t001", "recall"), ("t001", "class_signal")]
    assert got[0][4] == '{"type":"offload","turn_index":0,"before_bytes":9}' and got[3][4] == '{"turn_index":0,"class":"mixed","confidence":0.5}'
    assert O.side_events(df.limit(0)).count() == 0


@pytest.mark.parametrize("after", ["records", "events"])
def test_a_batch_that_fails_and_comes_again_adds_nothing(spark, tmp_path, after):
    batches(spark, tmp_path / "in", [[1.0] * 3, [1.0] * 4, [1.0] * 2])
    root, failures = str(tmp_path / "out"), []

    def failing(batch, batch_id):
        if batch_id == 1 and not failures:
            failures.append(batch_id)
            if after == "events":
                O.to_folders(root)(batch, batch_id)
            else:
                batch.limit(2).write.mode("overwrite").json(f"{root}/records/batch=1")
            raise RuntimeError("lost")
        O.to_folders(root)(batch, batch_id)

    for attempt in range(2):
        q = stream(spark, tmp_path / "in").writeStream.foreachBatch(failing).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        if attempt == 0:
            with pytest.raises(Exception, match="lost"):
                q.awaitTermination()
        else:
            q.awaitTermination()
    assert failures == [1]
    assert Counter(r["task_id"] for r in rows(spark, tmp_path / "out/records")) == Counter(f"t{i:03}" for i in range(9))
    assert Counter(r["kind"] for r in rows(spark, tmp_path / "out/events")) == Counter(compaction=8, recall=4, class_signal=4)


def test_a_stream_stops_at_the_batch_that_the_breaker_names(spark, tmp_path):
    costs = [[0.1] * 8] * 3 + [[2.0] * 8, [2.5] * 8, [0.1] * 8, [0.1] * 8]
    batches(spark, tmp_path / "in", costs)
    total, budget = 100, 50.0
    flat = [(i, k, c) for k, group in enumerate(costs) for i, c in enumerate(group, start=sum(map(len, costs[:k])))]
    df = spark.createDataFrame(flat, "at int, batch int, cost double")
    # the guard looks at the end of each batch
    ends = [sum(map(len, costs[: k + 1])) - 1 for k in range(len(costs))]
    want = min(r["batch"] for r in E.breaker(df, ["at"], "cost", total, budget).collect() if r["halted"] and r["at"] in ends)
    guard = O.CostGuard(total, budget)
    got = O.run_guarded(stream(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), guard)
    assert got == want and 0 < want < len(costs) - 1 and guard.reason.startswith("projected $")
    assert len(rows(spark, tmp_path / "out/records")) == ends[want] + 1
    # a larger budget goes on where it stopped, and reads nothing twice
    again = O.CostGuard(total, 1e9)
    assert O.run_guarded(stream(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), again) is None
    assert Counter(r["task_id"] for r in rows(spark, tmp_path / "out/records")) == Counter(f"t{i:03}" for i in range(len(flat)))


def test_guard_counts_a_batch_once_and_needs_enough_tasks():
    guard = O.CostGuard(100, 1.0)
    for _ in range(3):
        guard.observe(0, 19, 190.0)
    assert (guard.tasks, guard.halted_at) == (19, None)
    guard.observe(1, 1, None)
    assert guard.halted_at == 1
    with pytest.raises(O.Halted):
        guard.let_pass(2)
