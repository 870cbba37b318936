"""The run store as a data source: whole lines, pruned cells, streams that read each line once."""

import json
from collections import Counter

import pytest

from trajet.sources import run_source as S


def line(i, **more):
    return json.dumps({"task_id": f"t{i}", "bench": "ignored", "cost_usd": i / 10, **more}) + "\n"


def cell(root, bench, config, seed, text):
    folder = root / bench / config / str(seed)
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / S.RECORDS, "a", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture
def store(tmp_path):
    for b in ("gaia", "tau"):
        for c in ("full", "ahc"):
            for s in (1, 2, 10):
                cell(tmp_path, b, c, s, "".join(line(i) for i in range(5)))
    cell(tmp_path, "gaia", "full", "x1", line(99))
    (tmp_path / "gaia" / "full" / "3").mkdir()
    (tmp_path / "notes.txt").write_text("no cell")
    return tmp_path


def files_read(df):
    return df.rdd.getNumPartitions()


def test_reads_every_cell_and_prunes(spark, store):
    everything = S.read_store(spark, str(store))
    assert everything.count() == 60 and files_read(everything) == 12
    one = S.read_store(spark, str(store), bench="tau", config_id="ahc", seed=10)
    assert files_read(one) == 1 and Counter((r["bench"], r["config_id"], r["seed"]) for r in one.collect()) == {("tau", "ahc", 10): 5}
    some = S.read_store(spark, str(store), seed=[1, 2], bench="gaia")
    assert files_read(some) == 4 and some.count() == 20
    assert S.read_store(spark, str(store), bench="none").count() == 0 and S.read_store(spark, str(store / "absent")).count() == 0
    # a filter on the records stays with Spark
    assert S.read_store(spark, str(store)).filter("cost_usd > 0.25 and seed = 1").count() == 8


def test_bad_lines_are_skipped_and_counted_apart(spark, tmp_path):
    cell(tmp_path, "b", "c", 1, line(1) + "\n   \n{broken\n[1]\n" + line(2, final_response_text="ünï code") + '{"no":"task"}\n' + line(3).rstrip("\n"))
    assert sorted(r["task_id"] for r in S.read_store(spark, str(tmp_path)).collect()) == ["t1", "t2", "t3"]


@pytest.mark.parametrize("split", [1, 7, 50, 1000])
def test_pieces_hold_every_line_once(tmp_path, split):
    text = "".join(line(i, final_response_text="é" * (i * 7 % 40)) + "\n" * (i % 3) for i in range(30)) + '{"task_id":"last"}'
    cell(tmp_path, "b", "c", 1, text)
    for chunk in (3, 64, 1 << 20):
        got = [v for p in S.pieces(S.cells(str(tmp_path)), {}, split) for b in S.read_lines(str(tmp_path), p, chunk) for v in b.column("value").to_pylist()]
        assert got == [x for x in text.split("\n") if x.strip()]


def test_stream_reads_what_is_appended_once(spark, tmp_path):
    root, name = tmp_path / "store", "streamed_store"

    def run():
        q = S.stream_store(spark, str(root), split=40).select("bench", "seed", "task_id").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return Counter(tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect())

    cell(root, "b", "c", 1, line(1) + line(2) + '{"task_id":')
    assert run() == Counter([("b", 1, "t1"), ("b", 1, "t2")])
    cell(root, "b", "c", 1, '"t3"}\n')
    cell(root, "b", "d", 2, line(1))
    assert run() == Counter([("b", 1, "t1"), ("b", 1, "t2"), ("b", 1, "t3"), ("b", 2, "t1")])
    assert run() == Counter([("b", 1, "t1"), ("b", 1, "t2"), ("b", 1, "t3"), ("b", 2, "t1")])
