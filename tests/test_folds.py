"""Session folds, searches and statistics against plain-Python versions, and what empty inputs answer."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources_streaming import read_all

from trajet.functions import text as T
from trajet.operators import classify, evaluation, fixtures, groups, memory, retail, windows
from trajet.streaming import state


def test_hysteresis_by_a_loop(spark):
    rng = random.Random(1)
    rows = [(s, i, rng.choice("ccmt")) for s in range(12) for i in range(rng.randrange(1, 80))]
    want = {}
    for s in range(12):
        last, pending = None, None
        for _, i, raw in sorted(r for r in rows if r[0] == s):
            if last is None or raw == last or raw == pending:
                last, pending = raw, None
            else:
                pending = raw
            want[s, i] = last
    df = spark.createDataFrame(rows, "session_id long, turn_index long, raw_class string").repartition(4)
    assert {(r["session_id"], r["turn_index"]): r["class"] for r in classify.hysteresis(df).collect()} == want


def test_pair_start_by_a_fixpoint(spark):
    rng = random.Random(2)
    seeds, pairs = [], []
    for s in range(60):
        seeds.append((s, rng.randrange(0, 60)))
        # results before their calls, too
        pairs += [(s, rng.randrange(0, 60), rng.randrange(0, 60)) for _ in range(rng.randrange(0, 14))]
    want = {}
    for s, start in seeds:
        while True:
            low = min([start, *(u for x, u, r in pairs if x == s and r >= start)])
            if low == start:
                break
            start = low
        want[s] = start
    got = windows.pair_start(spark.createDataFrame(seeds, "session_id long, start long"), spark.createDataFrame(pairs, "session_id long, use_idx long, result_idx long").repartition(3))
    assert {r["session_id"]: r["start"] for r in got.collect()} == want


def offload_rows(sizes):
    return [(s, i, f"g{i:06}", f"t{i}", "web_search", n, 0) for s, ns in sizes.items() for i, n in enumerate(ns)]


OFFLOAD = "session_id long, result_idx long, group_id string, use_id string, tool_name string, result_bytes long, turn_index long"


def test_offload_by_a_loop_and_at_length(spark):
    rng = random.Random(3)
    sizes = {s: [rng.randrange(0, 5_000) for _ in range(rng.randrange(0, 40))] for s in range(15)}
    want = {}
    for s, ns in sizes.items():
        kept = 0
        for i, n in enumerate(ns):
            goes = len(ns) - i - 1 >= 2 and (n > 4096 or kept + n > 24_000)
            want[s, i] = goes, kept
            kept += 0 if goes else n
    got = groups.offload(spark.createDataFrame(offload_rows(sizes), OFFLOAD).repartition(5))
    assert {(r["session_id"], r["result_idx"]): (r["offloaded"], r["kept_before"]) for r in got.collect()} == want
    assert groups.offload(spark.createDataFrame([], OFFLOAD)).count() == 0
    # one session of 100,000 groups, in time that grows with its length alone
    long = spark.range(100_000).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("result_idx"), F.format_string("g%06d", "id").alias("group_id"), F.lit("t").alias("use_id"),
                                       F.lit("x").alias("tool_name"), (F.col("id") % 5000).alias("result_bytes"), F.lit(0).cast("long").alias("turn_index"))
    began = time.perf_counter()
    assert groups.offload(long).filter("not offloaded").count() < 1_000
    cls = long.select("session_id", F.col("result_idx").alias("turn_index"), F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("result_idx") % 7 % 2 + 1).cast("int")).alias("raw_class"))
    assert classify.hysteresis(cls).count() == 100_000
    pairs = long.select("session_id", F.col("result_idx").alias("use_idx"), (F.col("result_idx") + 2).alias("result_idx"))
    assert windows.pair_start(spark.createDataFrame([(1, 99_000)], "session_id long, start long"), pairs).first()["start"] == 0
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("block", [7, 10_000])
def test_nearest_by_brute_force(spark, block):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-3, 4, (200, 5)).astype(float)
    vectors[5] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, [1.0] * 5), (900, None)], "vec_id long, embedding array<double>").repartition(6)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in memory.nearest(df, df.filter("vec_id % 20 = 0"), 10, block=block).collect()}
    norm = np.linalg.norm(vectors, axis=1)
    unit = np.divide(vectors, norm[:, None], out=np.zeros_like(vectors), where=norm[:, None] > 0)
    for q in range(0, 200, 20):
        near = np.round(unit @ unit[q], 5)
        want = sorted((i for i in range(200) if i != q), key=lambda i: (-near[i], i))[:10]
        assert [got[q, r] for r in range(1, 11)] == want
    assert memory.nearest(df, df.limit(0), 10).count() == 0


def test_blocks_of_vectors_are_compared_by_tiles():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(6)
    ids, units = np.arange(10_000), rng.normal(size=(10_000, 4))
    row = [ids[:1_000].tobytes(), units[:1_000].tobytes(), ids.tobytes(), units.tobytes()]
    batch = pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["asked", "asked_units", "ids", "units"])
    tracemalloc.start()
    assert sum(b.num_rows for b in memory._best_of(5, 5)([batch])) == 5_000
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_statistics_of_nothing_and_of_one_value(spark):
    none = spark.createDataFrame([], "task_id long, diff double")
    p = evaluation.permutation_test(none, 50).first()
    assert (p["n"], p["delta"], p["p_value"], p["p_pooled"]) == (0, 0.0, 1.0, 1.0)
    b = evaluation.bootstrap(none.select(F.col("diff").alias("score")), 50).first()
    assert (b["accuracy"], b["lo"], b["hi"]) == (0.0, 0.0, 0.0)
    alike = spark.createDataFrame([(i, 0.0) for i in range(9)], none.schema)
    assert evaluation.permutation_test(alike, 50).first()["p_value"] == 1.0


def test_permutation_and_bootstrap_against_their_distributions(spark):
    # 12 pairs of one difference: p is the two-sided binomial tail
    diffs = spark.createDataFrame([(i, 1.0 if i < 10 else -1.0) for i in range(12)] + [(99, 0.0)], "task_id long, diff double")
    p = evaluation.permutation_test(diffs, 10_000).first()
    assert p["n"] == 13 and p["p_value"] == pytest.approx(2 * (1 + 12 + 66) / 4096, abs=0.008)
    # many pairs take several digests; two values add up
    many = spark.createDataFrame([(i, [0.5, -0.5, 2.0][i % 3]) for i in range(900)], "task_id long, diff double")
    assert evaluation.permutation_test(many, 300).first()["p_value"] == 0.0
    scores = spark.createDataFrame([(float(i % 4 == 0),) for i in range(400)], "score double")
    b = evaluation.bootstrap(scores, 4_000).first()
    sd = (0.25 * 0.75 / 400) ** 0.5
    assert b["accuracy"] == 0.25 and b["lo"] == pytest.approx(0.25 - 1.96 * sd, abs=0.006) and b["hi"] == pytest.approx(0.25 + 1.96 * sd, abs=0.006)


def test_turn_events(spark):
    turns = spark.createDataFrame([(1, 0, [], ["own"], "mixed"), (1, 1, ["c0"], [], None), (2, 0, [], [], "mixed")], "task_id long, turn_index int, compaction_events array<string>, recall_events array<string>, class_signal string")
    events = [(1, 3, "class_signal", 0, "late"), (1, 1, "class_signal", 0, "early"), (1, 2, "recall", 0, "new"), (1, 5, "compaction", 0, "b"), (1, 4, "compaction", 0, "a"), (1, 6, "compaction", 1, "c1"), (1, 7, "recall", 9, "nowhere")]
    got = evaluation.merge_turn_events(turns, spark.createDataFrame(events, "task_id long, seq long, kind string, turn_index int, payload string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, ["a", "b"], ["own"], "late"), (1, 1, ["c0"], [], None), (2, 0, [], [], "mixed")]


def test_subsets_compare_nested_values(spark):
    cases = [('{"a": {"x": 1, "y": [1, 2]}}', '{"b": 0, "a": {"y": [1, 2], "x": 1}}', True), ('{"a": {"x": 1}}', '{"a": {"x": 1, "y": 2}}', False), ('{"a": null}', '{"b": 1}', False),
             ('{"a": null}', '{"a": null}', True), ("{}", "{}", True), ('{"a": [1, 2]}', '{"a": [2, 1]}', False), ('{"a": "1"}', '{"a": 1}', False), ("{}", "[1]", False), ("{}", None, False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r["i"]: r["ok"] for r in df.select("i", fixtures.is_subset(F.col("a"), F.col("b")).alias("ok")).collect()}
    assert got == {i: ok for i, (_, _, ok) in enumerate(cases)}


def test_retail_lookups(spark):
    users = spark.createDataFrame([(1, "alice@example.com", "Alice", "Smith", "90210"), (2, None, "Bob", None, "1")], "user_id long, email string, first_name string, last_name string, zip string")
    asked = spark.createDataFrame([("alice@example.com",), ("nobody@example.com",), (None,)], "email string")
    assert {r["email"]: r["answer"] for r in retail.find_user_by_email(users, asked).collect()} == {"alice@example.com": "1", "nobody@example.com": "user_id_not_found", None: "user_id_not_found"}
    names = spark.createDataFrame([("Alice", "Smith", "90210"), ("Bob", "Smith", "90210")], "first_name string, last_name string, zip string")
    assert [r["answer"] for r in retail.find_user_by_name_zip(users, names).orderBy("first_name").collect()] == ["1", "user_id_not_found"]
    d = {r["user_id"]: r for r in retail.details(users, spark.createDataFrame([(1,), (7,)], "user_id long"), "user").collect()}
    assert d[1]["details"]["email"] == "alice@example.com" and d[1]["error"] is None and d[7]["details"] is None and d[7]["error"] == "user not found: 7"


def test_vocabulary_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello, world! née 日本", "x " * 500]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(T.vocabulary_tokens(F.col("text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).collect()]
    assert got == [len(enc.encode_ordinary(t or "")) for t in texts]


def test_states_end(spark, tmp_path):
    """A session that is silent for longer than its timer starts anew; the scratchpad says that it was emptied."""
    import pandas as pd

    def play(name, op, rows, schema, mode="append", wait=4):
        path = str(tmp_path / name)
        spark.createDataFrame(rows[:1], schema).coalesce(1).write.mode("append").parquet(path)
        q = op(spark.readStream.schema(schema).parquet(path)).writeStream.outputMode(mode).format("memory").queryName(name).trigger(processingTime="300 milliseconds").start()
        try:
            read_all(q, 1)
            time.sleep(wait)
            spark.createDataFrame(rows[1:], schema).coalesce(1).write.mode("append").parquet(path)
            read_all(q, 2)
            return spark.table(name).collect()
        finally:
            q.stop()

    cls = "session_id long, turn_index long, raw_class string"
    out = play("hysteresis_end", lambda s: state.hysteresis_stream(s, kept_ms=500), [(1, 0, "a"), (1, 1, "b")], cls)
    assert [r["class"] for r in sorted(out, key=lambda r: r["turn_index"])] == ["a", "b"]
    out = play("tier2_end", lambda s: state.tier2_stream(s, kept_ms=500), [(1, 0, 0, "x"), (1, 1, 1, "y")], "session_id long, seq long, turn_index long, statement string", "update")
    assert out[-1]["observations"] == 1
    out = play("prepared_end", lambda s: state.prepared_stream(s, kept_ms=500), [(1, 0, "prepare", "h"), (1, 1, "consume", "h")], "session_id long, seq long, kind string, hash string")
    assert [r["answer"] for r in sorted(out, key=lambda r: r["seq"])] == ["kept", "miss"]
    out = play("rate_end", lambda s: state.rate_limit_stream(s, 1e9, 1, kept_ms=500), [(1, 0, 0.0), (1, 1, 1.0)], "session_id long, event_id long, t double")
    assert all(r["allowed"] for r in out)
    at = pd.Timestamp("2024-01-01").to_pydatetime()
    out = play("pad_end", lambda s: state.scratchpad_stream(s, idle_ms=500), [(1, at, 5), (1, at, 7)], "session_id long, ts timestamp, size long", "update")
    assert [(r["entries"], r["bytes"], r["evictions"]) for r in out] == [(1, 5, 0), (0, 0, 1), (1, 7, 0)]


def test_list_entries_are_trimmed_of_blanks_alone(spark):
    from trajet.functions import grading as G

    cases = [("DE,1328.0,src13!", "de, 1328; src13", True), (" a ,1, 22", "a,1,22", True), ("a,2,22", "a,1,22", False), ("1 apple", "1", True), ("1d", "1", True), ("x", "1", False)]
    df = spark.createDataFrame([(i, a, t) for i, (a, t, _) in enumerate(cases)], "i int, a string, t string")
    assert {r["i"]: r["ok"] for r in df.select("i", G.grade(F.col("a"), F.col("t")).alias("ok")).collect()} == {i: ok for i, (_, _, ok) in enumerate(cases)}


def test_pages_drop_all_boilerplate_and_take_a_heading_for_a_title():
    from trajet.operators import pages

    html = "<body><aside><p>side</p></aside><svg><title>icon</title></svg><iframe><p>in</p></iframe><h1>Main</h1><table><tr><th>Head</th><td>cell</td></tr></table></body>"
    assert pages.extract(html) == ("Main", "Main\n\nHead\n\ncell")
    assert pages.extract("<title>First</title><title>Second</title><p>x</p>") == ("First", "x")
    assert pages.extract("<p>Only text.</p>") == ("", "Only text.")
