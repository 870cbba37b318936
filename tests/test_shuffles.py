"""The generator and the swap shuffle against loops."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trajet.functions.generators import draw32
from trajet.operators import shuffles


def generator(seed):
    """Written with whole numbers and masks."""
    s = seed % 2**32
    while True:
        s = (s + 0x6D2B79F5) % 2**32
        t = (s ^ s >> 15) * (s | 1) % 2**32
        t ^= (t + (t ^ t >> 7) * (t | 61)) % 2**32
        yield t ^ t >> 14


def swap(rows, draws):
    for i in range(len(rows) - 1, 0, -1):
        j = next(draws) * (i + 1) // 2**32
        rows[i], rows[j] = rows[j], rows[i]


def sample(items, n, seed):
    draws, pools = generator(seed), defaultdict(list)
    for kind, i in items:
        pools[kind].append(i)
    raw = {k: n * len(v) / len(items) for k, v in pools.items()}
    quota = {k: int(x) for k, x in raw.items()}
    for k, _ in sorted(raw.items(), key=lambda x: -(x[1] - int(x[1])))[: n - sum(quota.values())]:
        quota[k] += 1
    out = []
    for k, v in pools.items():
        swap(v, draws)
        out += v[: quota[k]]
    swap(out, draws)
    return out


@pytest.mark.parametrize("seed", [0, 1, 42, 2**31, 2**32 - 1])
def test_draws(spark, seed):
    got = [r["u"] for r in spark.range(500).select(draw32(seed, F.col("id")).alias("u"), "id").orderBy("id").collect()]
    g = generator(seed)
    assert got == [next(g) for _ in range(500)]
    far = spark.createDataFrame([(2**31,), (2**40,)], "n long").select(draw32(seed, F.col("n")).alias("u")).collect()
    assert all(0 <= r["u"] < 2**32 for r in far)


def test_known_first_draw(spark):
    # 0.6011037519201636 is the first number of this generator with seed 42
    assert spark.range(1).select((draw32(42, F.col("id")) / 2**32).alias("u")).first()["u"] == pytest.approx(0.6011037519201636, abs=1e-15)


def test_shuffle_of_pools_side_by_side(spark):
    sizes, base, rows, want = {"a": 1, "b": 2, "c": 57, "d": 400}, 0, [], {}
    draws = generator(7)
    for pool, n in sizes.items():
        rows += [(pool, i, n, base) for i in range(n)]
        held = list(range(n))
        swap(held, draws)
        want |= {(pool, x): at for at, x in enumerate(held)}
        base += n - 1
    df = spark.createDataFrame(rows, "pool string, place long, size long, base long")
    assert {(r["pool"], r["place"]): r["shuffled"] for r in shuffles.shuffled(df, 7).collect()} == want
    assert shuffles.shuffled(df.limit(0), 7).count() == 0


@pytest.mark.parametrize("n, kinds", [(12, "aabbbbccccccccdddddddddddddddddddd"), (5, "zzzyx"), (7, "qqqqqqqqqqqqqqqqqqqqq")])
def test_sample_in_strata(spark, n, kinds):
    items = [(k, i) for i, k in enumerate(kinds[::2] + kinds[1::2])]
    got = shuffles.stratified_shuffle(spark.createDataFrame(items, "kind string, id long").repartition(3), "kind", "id", n, 42)
    assert [r["id"] for r in got.orderBy("place").collect()] == sample(items, n, 42)


def test_numbers_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(9)
    assert all(r["v"] == r["place"] for r in shuffles.numbered(df, "v").collect())
    assert shuffles.numbered(df.limit(0), "v").count() == 0
