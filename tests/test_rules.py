"""Rule trees of mixed depth, collated orders, calibration without the trace itself."""

import pytest

from trajet.operators import rules

NODES = "task_id int, node_id int, parent_id int, rule string, score double"


def scores(spark, rows):
    return {r["task_id"]: r["score"] for r in rules.rule_scores(spark.createDataFrame(rows, NODES)).collect()}


def test_trees_of_mixed_depth(spark):
    rows = [
        (1, 0, None, None, 0.25),  # a leaf alone
        (2, 0, None, "all", None), (2, 1, 0, None, 1.0), (2, 2, 0, "any", None), (2, 3, 2, None, 0.0), (2, 4, 2, "mean", None), (2, 5, 4, None, 1.0), (2, 6, 4, None, 1.0),
        (3, 9, None, "mean", None), (3, 8, 9, None, 0.5), (3, 7, 9, "all", None), (3, 6, 7, None, None), (3, 5, 9, "any", None), (3, 4, 9, "mean", None), (3, 3, 9, "all", None),
    ]
    # rules over nothing: any and mean 0, all 1; a leaf without a score is 0
    assert scores(spark, rows) == {1: 0.25, 2: 1.0, 3: pytest.approx((0.5 + 0 + 0 + 0 + 1) / 5)}
    assert scores(spark, []) == {}


def test_a_long_chain_takes_few_rounds_to_place(spark):
    n = 60
    rows = [(1, i, i - 1 if i else None, "all" if i < n - 1 else None, 1.0) for i in range(n)]
    placed = rules.levels(spark.createDataFrame(rows, NODES)).collect()
    assert all(r["level"] == r["node_id"] for r in placed)


@pytest.mark.parametrize("rows", [[(1, 0, 1, "all", None), (1, 1, 0, "all", None)], [(1, 0, None, "all", None), (1, 5, 5, "any", None)], [(1, 0, None, "all", None), (1, 2, 7, None, 1.0)]])
def test_cycles_and_absent_parents_are_refused(spark, rows):
    with pytest.raises(ValueError, match="leads to no root"):
        scores(spark, rows)


def test_collated_order(spark):
    names = ["zebra", "Zebra", "apple", "Äpfel", "apfel", "Apfel", "äpfel", "APFEL", None, "é", "e", "E", "f"]
    got = [r["v"] for r in spark.createDataFrame([(n,) for n in names], "v string").orderBy(*rules.collated("v")).collect()]
    assert got == [None, "apfel", "Apfel", "APFEL", "äpfel", "Äpfel", "apple", "e", "E", "é", "f", "zebra", "Zebra"]


def test_left_out_calibration_is_a_refit(spark):
    traces = [(t, (t * 37 + k * 91) % 500, (t + k) % 3 == 0) for t in range(6) for k in range(20)] + [(0, None, True), (5, 400, None)]
    grid = [50.0, 120.0, 300.0, 450.0]
    got = {(r["trace_id"], r["threshold"]): tuple(r)[2:] for r in rules.calibrate_left_out(spark.createDataFrame(traces, "trace_id int, size int, useful boolean"), grid).collect()}
    assert len(got) == 24
    for t in range(6):
        points = {}
        for g in grid:
            over = [x for x in traces if x[1] is not None and x[1] > g]
            rest, own = [x for x in over if x[0] != t], [x for x in over if x[0] == t]
            points[g] = sum(x[1] for x in rest), sum(bool(x[2]) for x in rest), sum(x[1] for x in own), sum(bool(x[2]) for x in own)
        for g, (saved, lost, *own) in points.items():
            front = not any(s >= saved and n <= lost and (s > saved or n < lost) for s, n, *_ in points.values())
            assert got[t, g] == (saved, lost, front, *own)
