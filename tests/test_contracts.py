"""A run's parts can be exchanged one by one."""

from pyspark.sql import functions as F

from trajet.operators.contracts import Bench, echo

TASKS = "task_id string, turn_index int, prompt string, expected string"


def test_parts_of_a_run(spark):
    rows = [("a", 0, "one two", None), ("a", 1, "Three", " three "), ("b", 0, "x", "y"), ("c", 0, "fail", None), ("c", 1, "never paid", "never paid"), ("d", 0, "p", None)]
    adapter = lambda seed: spark.createDataFrame(rows, TASKS)
    got = {r["task_id"]: r for r in Bench(adapter).run(1).collect()}
    assert [got[t]["score"] for t in "abcd"] == [1, 0, 1, 0] and got["a"]["response"] == "Three" and got["a"]["input_tokens"] == 4
    failing = lambda t: echo(t).withColumn("response", F.when(F.col("prompt") != "fail", F.col("response")))
    words = lambda c: F.size(F.split(c, " ")).cast("long")
    bench = Bench(adapter, failing, lambda r, e: F.length(r).cast("double"), words, 1.0, 10.0)
    got = {r["task_id"]: r for r in bench.run(5).collect()}
    assert (got["c"]["n_turns"], got["c"]["n_errors"], got["c"]["score"], got["c"]["input_tokens"]) == (1, 1, 0.0, 1)
    assert got["a"]["score"] == 5 and got["a"]["cost_usd"] == (3 + 30) / 1e6 and got["a"]["seed"] == 5
    assert Bench(lambda s: spark.createDataFrame([], TASKS)).run(1).count() == 0
