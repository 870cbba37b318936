"""Statistics whose cost does not grow with rows or distinct values, against enumeration and simulation."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajet.operators import evaluation as E


def enumerated(d):
    s = abs(sum(d))
    sums = np.zeros(1)
    for x in d:
        sums = np.concatenate((sums + x, sums - x))
    return float((np.abs(sums) >= s - 1e-9).mean())


def flip(spark, d):
    return E.sign_flip_test(spark.createDataFrame([(None if x is None else float(x),) for x in d], "diff double")).first()


@pytest.mark.parametrize("step", [1, 1 / 4, 1 / 10, 1 / 100])
def test_sixteen_pairs_on_a_lattice_are_exact(spark, step):
    r = np.random.default_rng(int(1 / step))
    for _ in range(3):
        d = (r.integers(-9, 14, 16) * step).tolist()
        got = flip(spark, [*d, None])
        assert got["n"] == 16 and got["p_value"] == pytest.approx(enumerated(d), abs=1e-9) and got["delta"] == pytest.approx(np.mean(d))
        assert got["p_pooled"] == pytest.approx((got["p_value"] * 10_000 + 1) / 10_001)


def test_sixteen_pairs_of_any_size(spark):
    r = np.random.default_rng(3)
    d = r.normal(0.4, 1, 16).tolist()
    assert flip(spark, d)["p_value"] == pytest.approx(enumerated(d), abs=2e-3)


def test_edges(spark):
    assert flip(spark, [])["p_value"] == flip(spark, [None])["p_value"] == flip(spark, [0.0, 0.0])["p_value"] == flip(spark, [1, -1])["p_value"] == 1
    assert flip(spark, [2.0])["p_value"] == pytest.approx(1) and flip(spark, [1.0] * 10)["p_value"] == pytest.approx(2 / 1024, abs=1e-12)
    assert flip(spark, [1.0] * 400)["p_value"] == pytest.approx(0, abs=1e-12)


def test_a_million_distinct_differences_cost_little_more_than_a_thousand(spark):
    took, got = [], []
    for n in (1_000, 1_000_000):
        df = spark.range(n).select(((F.xxhash64("id", F.lit(5)) / 2.0**63) + 1.5 / F.sqrt(F.lit(float(n)))).alias("diff")).cache()
        df.count()
        began = time.perf_counter()
        got.append((E.sign_flip_test(df).first(), df.agg(F.sum("diff"), F.sum(F.col("diff") ** 2)).first()))
        took.append(time.perf_counter() - began)
    for row, (s, squares) in got:
        # the normal limit
        from math import erfc, sqrt

        assert row["p_value"] == pytest.approx(erfc(abs(s) / sqrt(2 * squares)), rel=0.05)
    assert took[1] < 6 * took[0] + 6, took


def interval(spark, scores, **more):
    r = E.resampled_interval(spark.createDataFrame([(None if x is None else float(x),) for x in scores], "score double"), **more).first()
    return r["accuracy"], r["lo"], r["hi"]


def test_resampled_interval_of_hits_is_binomial(spark):
    from math import comb

    n, k = 40, 13
    cdf = np.cumsum([comb(n, i) * (k / n) ** i * (1 - k / n) ** (n - i) for i in range(n + 1)])
    want = [int(np.argmax(cdf >= level - 1e-12)) / n for level in (251 / 10_000, 9751 / 10_000)]
    assert interval(spark, [1] * k + [0] * (n - k)) == pytest.approx((k / n, *want))


@pytest.mark.parametrize("kind", ["quarters", "any", "skewed"])
def test_resampled_interval_is_the_limit_of_resampling(spark, kind):
    r = np.random.default_rng(6)
    scores = {"quarters": r.integers(0, 5, 60) / 4, "any": r.random(80), "skewed": np.r_[r.random(30) / 10, 5.0]}[kind]
    means = np.sort(r.choice(scores, (200_000, len(scores))).mean(1))
    acc, lo, hi = interval(spark, scores.tolist())
    sd = scores.std() / len(scores) ** 0.5
    assert acc == pytest.approx(scores.mean()) and abs(lo - means[5_000]) < 0.05 * sd and abs(hi - means[195_000]) < 0.05 * sd


def test_resampled_interval_edges(spark):
    assert interval(spark, []) == interval(spark, [None]) == (0, 0, 0)
    assert interval(spark, [0.3] * 5 + [None]) == pytest.approx((0.3, 0.3, 0.3)) and interval(spark, [0.7]) == pytest.approx((0.7, 0.7, 0.7))


def test_resampled_interval_takes_the_same_time_for_more_rows(spark):
    took = []
    for n in (1_000, 1_000_000):
        df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(9)) / 8).alias("score")).cache()
        df.count()
        began = time.perf_counter()
        r = E.resampled_interval(df).first()
        took.append(time.perf_counter() - began)
        sd = df.agg(F.stddev_pop("score")).first()[0] / n**0.5
        assert r["lo"] == pytest.approx(r["accuracy"] - 1.96 * sd, abs=0.1 * sd) and r["hi"] == pytest.approx(r["accuracy"] + 1.96 * sd, abs=0.1 * sd)
    assert took[1] < 5 * took[0] + 6, took


def test_draws_of_a_resample_are_counted_by_ranges(spark, monkeypatch):
    from hashlib import sha256

    monkeypatch.setattr(E, "DRAWN_BLOCKS", 3)
    for n, k in ((1, 1), (24, 5), (77, 30)):
        got = E.bootstrap(spark.createDataFrame([(float(i < k),) for i in range(n)], "score double").coalesce(1), 40).first()
        digests = lambda rep: b"".join(sha256(f"{rep}:{b}:0".encode()).digest() for b in range((n + 7) // 8))
        means = sorted((np.frombuffer(digests(rep), ">u4")[:n] % n < k).mean() for rep in range(40))
        assert tuple(got) == pytest.approx((k / n, means[1], means[39]))


def test_breaker_and_top_results_as_sql_has_them_on_odd_rows(spark, tmp_path):
    """Costs whose mean meets the limit but for rounding, equal rows, nulls and values that are no numbers."""
    import oracle
    from trajet.plans import ORACLES, QUERIES

    con = oracle.duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    r = np.random.default_rng(5)
    events = []
    for user in range(300):
        cents = r.integers(0, 9_000, 40)
        cents[19] = max(0, 20 * 4_500 - int(cents[:19].sum()))  # a mean of 45 exactly after 20 rows
        events += [(user, user * 100 + i, i, c / 100) for i, c in enumerate(cents.tolist())]
    events += [(1_000 + u, i, None if (u + i) % 7 == 0 else i // 2, [None, float("nan"), 90.0, 1.0, 45.0][(i * u) % (5 if u % 2 else 4)] if i % 9 == 0 else 45.0) for u in range(20) for i in range(40)]
    events += [(2_000, 1, 5, 50.0)] * 40
    df = spark.createDataFrame(events, "user_id long, event_id long, at long, value double").selectExpr("user_id", "event_id", "timestamp_seconds(at) AS ts", "value")
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    lines = [(k, p, n, x) for k in range(60) for p, n, x in ((5, 1, 9.5), (3, 1, 9.5), (4, 1, 9.5), (7, 2, None), (8, None, 9.5), (None, 3, 1.0), (6, 4, float("nan")), (k, 5, -0.0), (2, 4, 0.0))[: 3 + k % 7]]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("q_cost_breaker", "q_top_results"):
        oracle.compare(spark, QUERIES[name], ORACLES[name], str(tmp_path), con)
