"""Helpers for groups of any size, on data where one key holds most rows."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from pulsemill.operators.indexing import dense_index, with_halo, with_next
from pulsemill.operators.quantiles import _narrow, exact_quantiles


def skewed(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 8, n))
    return spark.createDataFrame([(int(k), int(i), float(v)) for k, i, v in zip(
        key, rng.permutation(n), np.round(rng.normal(size=n), 2))], "k int, pos bigint, v double")


def test_dense_index_equals_row_number(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("v", "pos")
    want = df.withColumn("n", F.row_number().over(w) - 1)
    got = dense_index(df, ["k"], ["v", "pos"], [F.floor("v"), F.floor(F.col("v") * 10)], "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dense_index_over_everything(spark):
    df = skewed(spark, 500)
    got = dense_index(df, [], ["pos"], [F.floor(F.col("pos") / 64)], "n").collect()
    assert all(r.n == r.pos for r in got)


def test_with_next_crosses_empty_blocks(spark):
    df = spark.createDataFrame([(1, p) for p in (0, 3, 100, 101)] + [(2, 5)], "k int, p bigint")
    got = with_next(df, ["k"], "p", F.floor(F.col("p") / 10), "nxt", "first").collect()
    assert {(r.k, r.p): (r.nxt, r.first) for r in got} == {
        (1, 0): (3, True), (1, 3): (100, False), (1, 100): (101, False), (1, 101): (None, False),
        (2, 5): (None, True)}


def test_with_halo_covers_neighbours(spark):
    df = spark.range(20).withColumnRenamed("id", "p")
    got = with_halo(df, "p", 8, 3, "b", "core").collect()
    block1 = sorted(r.p for r in got if r.b == 1)
    assert block1 == list(range(5, 19))
    assert sorted(r.p for r in got if r.core) == list(range(20))


def check_quantiles(df, got, probs):
    rows = {r.k: [r[p] for p in probs] for r in got.collect()}
    data = {}
    for r in df.collect():
        if r.v is not None and np.isfinite(r.v):
            data.setdefault(r.k, []).append(r.v)
    assert set(rows) == set(data)
    for k, v in data.items():
        np.testing.assert_allclose(rows[k], np.percentile(v, [100 * p for p in probs.values()]),
                                   rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("bin_rows,grid", [(20, 16), (10 ** 6, 256)])
def test_quantiles_with_and_without_narrowing(spark, bin_rows, grid):
    df = skewed(spark, 2000)
    extra = spark.createDataFrame([(9, 0, 1e12), (9, 1, -5.0), (9, 2, 0.0), (10, 0, 4.0),
                                   (11, 0, None), (0, -1, float("nan"))]
                                  + [(12, k, 1e12 if k < 3 else 1e8 if k < 6 else k % 700 / 7.0) for k in range(1500)]
                                  + [(13, k, 1.0 if k % 3 else float(k % 5)) for k in range(900)], "k int, pos bigint, v double")
    df = df.unionByName(extra)
    probs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.99, "f": 1.0}
    check_quantiles(df, exact_quantiles(df, ["k"], "v", probs, bin_rows, grid, 8 * grid), probs)


def test_outliers_do_not_widen_the_last_bin(spark):
    """Bins of equal width would hold nearly all rows; these follow the ranks."""
    n = 20_000
    df = spark.createDataFrame([(0, 1e12 if k == 0 else -1e8 if k == 1 else (k * 7919 % n) / n) for k in range(n)], "k int, v double")
    rows = df.select("k", F.col("v").alias("__v"))
    bins = spark.createDataFrame([(0, 1, [n // 4], float("-inf"), float("inf"), 0, n)],
                                 "k int, __k int, __ranks array<bigint>, __lo double, __hi double, __below bigint, __inside bigint")
    r = _narrow(rows, bins, ["k"], 256, 2048).first()
    assert r["__inside"] < n * 8 / 256 and r["__below"] <= n // 4 < r["__below"] + r["__inside"]


def test_quantiles_of_everything(spark):
    df = skewed(spark, 300)
    got = exact_quantiles(df, [], "v", {"m": 0.5}, bin_rows=10, grid=16).first().m
    assert got == pytest.approx(np.median([r.v for r in df.collect()]))
    assert exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
