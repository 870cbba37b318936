"""Manifests, subset fixtures, prepared compactions, provider-side accounting."""

import json

from test_sources_streaming import stream

from trajet.operators import fixtures
from trajet.operators import server_compaction as S
from trajet.sources import manifest
from trajet.streaming import state

GOOD = {"benches": ["b"], "configs": [{"id": "x"}, {"id": "y"}], "seeds": [0, 1], "budget_usd": 5, "max_tasks": 2}


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(GOOD))
    m = manifest.read_manifest(spark, str(tmp_path / "m.json"))
    assert manifest.problems(m) == []
    assert set(manifest.problems({"configs": [{"id": "x"}, {"id": "x"}], "benches": [], "seeds": ["a"]})) == {"missing budget_usd", "benches must be a list with entries", "configs need distinct ids", "seeds must be whole numbers"}
    tasks = spark.createDataFrame([("b", "t1"), ("b", "t2"), ("b", "t3"), ("c", "t1")], "bench string, task_id string")
    done = spark.createDataFrame([("b", "x", 0, "t1")], "bench string, config_id string, seed int, task_id string")
    assert manifest.work_units(m, tasks).count() == 8 and manifest.work_units(m, tasks, done).count() == 7


def test_subset_fixtures(spark):
    calls = spark.createDataFrame([(1, 0, "s", '{"q":"a","n":1}'), (1, 1, "s", '{"q":"b"}'), (1, 2, "s", '{"q":"c","o":{"k":[1]}}')], "session_id long, seq long, tool_name string, args string")
    rows = [("s", "subset", '{"q":"a"}', 0, "A"), ("s", "subset", '{"o":{"k":[1]}}', 1, "O"), ("s", "first", None, 0, "F"), ("s", "exact", '{"q":"zz"}', 0, "Z")]
    fx = spark.createDataFrame(rows, "tool_name string, kind string, args string, slot int, output string")
    assert [(r["matched_by"], r["output"]) for r in fixtures.replay(calls, fx).orderBy("seq").collect()] == [("subset", "A"), ("first", "F"), ("subset", "O")]


def test_prepared_stream(spark, tmp_path):
    kinds = [("prepare", "h"), ("prepare", "i"), ("consume", "h"), ("consume", "h"), ("prepare", "j"), ("consume", "k"), ("prepare", "l"), ("invalidate", None)]
    df = spark.createDataFrame([(i, 1, i, k, h) for i, (k, h) in enumerate(kinds)], "n long, session_id long, seq long, kind string, hash string")
    got = [r["answer"] for r in stream(spark, df, str(tmp_path / "q"), state.prepared_stream).orderBy("seq").collect()]
    assert got == ["kept", "busy", "hit", "miss", "kept", "stale", "kept", "cleared"]


def test_provider_side(spark):
    df = spark.createDataFrame([(1, 0, None, "abc"), (1, 1, "B1", "abcdef"), (1, 2, None, "x"), (1, 3, "B22", "xyz")], "session_id long, turn_index long, block string, sent string")
    assert [r["standing"] for r in S.standing_block(df).orderBy("turn_index").collect()] == [None, "B1", "B1", "B22"]
    assert {(r["turn_index"], r["before_bytes"], r["after_bytes"]) for r in S.compaction_events(df).collect()} == {(1, 6, 2), (3, 3, 3)}
    turns = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b ##STOP##", "c"])] + [(2, i, "x") for i in range(5)], "session_id long, turn_index long, text string")
    assert {(r["session_id"], r["turn_index"]) for r in S.until_stop(turns, most=3).collect()} == {(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)}
    rows = [(1, 0, "classifier_signal", None, "mixed", None, None), (1, 1, "compaction", "offload", None, 900, 100), (1, 2, "compaction", "offload", None, 10, 50), (1, 3, "recall", None, None, None, None), (1, 4, "classifier_signal", None, "tool_heavy", None, None)]
    ev = spark.createDataFrame(rows, "session_id long, seq long, kind string, type string, class string, before_bytes long, after_bytes long")
    assert tuple(S.session_report(ev).first())[1:] == ("tool_heavy", 0, 2, 1, 200)
