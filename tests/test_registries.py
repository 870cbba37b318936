"""State with contents: a replayed stream answers as the table does."""

import datetime as dt
from collections import Counter

import pytest

from trajet.streaming import registries as R

ACCESS = "session_id long, seq long, ts timestamp, kind string, group_id string, content string"


def replay(spark, tmp_path, rows, schema, build, batches=4):
    """Rows as `batches` files, one a trigger; what the stream gave out."""
    source, size = tmp_path / "in", -(-len(rows) // batches)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").json(str(source))
    name = f"replayed_{tmp_path.name.replace('-', '_')}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    mode = "update" if build is R.observation_contents else "append"
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def accesses(seed=1, n=160):
    import random

    r, at, seq, rows = random.Random(seed), dt.datetime(2026, 1, 1), Counter(), []
    for _ in range(n):
        at += dt.timedelta(seconds=r.choice((1, 20, 200)))
        s = r.randrange(4)
        seq[s] += 1
        put = r.random() < 0.5
        rows.append((s, seq[s], at, "put" if put else "recall", f"g{r.randrange(4)}", f"c{r.randrange(99)}" if put else None))
    return rows


def test_scratchpad_answers_as_the_table(spark, tmp_path):
    rows, idle = accesses(), 500_000
    got = Counter(tuple(r) for r in replay(spark, tmp_path, rows, ACCESS, lambda s: R.scratchpad_contents(s, idle)))
    want = Counter(tuple(r) for r in R.scratchpad_answers(spark.createDataFrame(rows, ACCESS), idle).collect())
    assert got == want
    kinds = Counter(r[4] for r in want.elements())
    assert min(kinds["kept"], kinds["found"], kinds["unknown"]) > 10


def test_idle_sessions_are_emptied_and_others_are_not(spark, tmp_path):
    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, 1, t(0), "put", "g", "a"), (2, 1, t(1), "put", "g", "b"), (1, 2, t(60), "recall", "g", None), (2, 2, t(62), "recall", "g", None), (1, 3, t(61), "put", "g", "c"), (1, 4, t(100), "recall", "g", None), (1, 5, t(100), "recall", "h", None)]
    batch = {(r["session_id"], r["seq"]): (r["answer"], r["content"], r["entries"]) for r in R.scratchpad_answers(spark.createDataFrame(rows, ACCESS), 60_000).collect()}
    # exactly the time to live is not yet idle
    assert batch == {(1, 1): ("kept", None, 1), (2, 1): ("kept", None, 1), (1, 2): ("found", "a", 1), (2, 2): ("unknown", None, 0), (1, 3): ("kept", None, 1), (1, 4): ("found", "c", 1), (1, 5): ("unknown", None, 1)}
    got = {(r["session_id"], r["seq"]): (r["answer"], r["content"], r["entries"]) for r in replay(spark, tmp_path, rows, ACCESS, lambda s: R.scratchpad_contents(s, 60_000), 7)}
    assert got == batch


def test_observations_grow_over_batches(spark, tmp_path):
    rows = [(i % 3, i, i // 3 if i % 4 else None, f"s{i}" if i % 5 else None) for i in range(30)]
    schema = "session_id long, seq long, turn_index long, statement string"
    want = {(r["session_id"], r["seq"]): (r["observations"], r["last_observed_turn"]) for r in R.observations_so_far(spark.createDataFrame(rows, schema)).collect()}
    got = replay(spark, tmp_path, rows, schema, R.observation_contents)
    assert len(got) == 12 and all(want[r["session_id"], r["seq"]] == (r["observations"], r["last_observed_turn"]) for r in got)
    assert R.observations_so_far(spark.createDataFrame([], schema)).count() == 0
