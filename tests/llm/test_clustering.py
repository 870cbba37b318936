"""Operator 13 against plain whole-number k-means, and its bounds against the distances they hold."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trajet.llm import clustering


def brute(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: ((0, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()) if r[0] is not None else (1, ""), r[1]))
    centroids = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        centroids = [[sum(x) // len(x) for x in zip(*groups[n])] if groups[n] else c for n, c in enumerate(centroids)]
    found = [(i, near(q)) for i, q in kept]
    inertia = Counter()
    for _, (d, n) in found:
        inertia[n] += d
    return Counter((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, (d, n) in found)


def run(spark, rows, schema="vec_id long, embedding array<float>, cluster string, distance string"):
    df = spark.createDataFrame([(*r, "x", None) for r in rows], schema)
    return Counter(tuple(r) for r in clustering.centroid_clusters(df).collect())


def as_float32(v):
    return [None if x is None else float(np.float32(x)) for x in v]


def test_against_plain_rounds(spark):
    r = np.random.default_rng(5)
    rows = [(i, as_float32(r.normal(0, 0.2, 64) + (i % 5))) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, [0.0] * 64)] + [(400 + i, rows[9][1]) for i in range(60)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63), (906, [float("-inf")] + [0.0] * 63)]
    assert run(spark, rows) == brute(rows)


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [0.5] * 64) for i in range(40)]
    assert run(spark, rows) == brute(rows)
    rows = [(i, as_float32(np.full(64, i / 3))) for i in range(5)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == Counter()
    assert run(spark, [(1, [1.0])]) == Counter()


def test_large_components_count_as_the_largest(spark):
    got = clustering.quantised(spark.createDataFrame([(1, [1e30] * 2), (2, [-1e30, 0.99])], "vec_id int, embedding array<double>"), size=2)
    assert {r["vec_id"]: r["whole"] for r in got.collect()} == {1: [clustering.MOST] * 2, 2: [-clustering.MOST, 63]}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 16), st.integers(1, 40), st.sampled_from([1, 50, 2**24]), st.integers(1, 12))
def test_bounds_hold_and_lose_no_nearest(seed, k, size, most, rank):
    r = np.random.default_rng(seed)
    # vectors of low rank too, whose apexes are flat
    whole = np.clip(np.round(r.normal(0, 1, (80, rank)) @ r.normal(0, most / 8, (rank, size))), -most, most).astype(np.int64)
    centroids = whole[r.choice(80, k)]
    simplex = clustering.Simplex(centroids)
    apexes, centres = (simplex.apexes(simplex.distances(x)) for x in (whole, centroids))
    true = ((whole[:, None] - centroids[None]) ** 2).sum(2)
    lower, upper = clustering.bounds(apexes, centres)
    assert (lower <= true).all() and (true <= upper).all()
    cluster, distance, compared = clustering.nearest(whole, apexes, centroids, centres)
    assert (cluster == true.argmin(1)).all() and (distance == true.min(1)).all() and compared <= true.size


def test_most_comparisons_are_saved():
    r = np.random.default_rng(1)
    whole = (r.normal(0, 3, (2000, 64)) + r.normal(0, 12, (16, 64))[r.integers(0, 16, 2000)]).astype(np.int64)
    centroids = whole[:16]
    simplex = clustering.Simplex(centroids)
    _, _, compared = clustering.nearest(whole, simplex.apexes(simplex.distances(whole)), centroids, simplex.apexes(simplex.distances(centroids)))
    assert compared < 16 * len(whole) / 2
