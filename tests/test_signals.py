"""Segments, windows and transforms against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.functions import arrays as A
from pulsemill.operators import signals as S, windows
from pulsemill.operators.indexing import range_index
from pulsemill.operators.windows import (assign_index, finite_segments, fixed_windows,
                                         slice_windows, tag_segments)


def record(spark, n=200, seed=0, fs=10.0, gaps=0.05, rec=1):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(size=n))
    x[rng.random(n) < gaps] = np.nan
    rows = [("train", 1, rec, i, fs, None if np.isnan(v) and i % 2 else float(v))
            for i, v in enumerate(x)]
    return x, spark.createDataFrame(
        rows, "split string, subject_id int, record_id int, i bigint, fs double, x double")


def runs(x, need):
    out, i = [], 0
    while i < len(x):
        j = i
        while j < len(x) and np.isfinite(x[j]):
            j += 1
        if j - i >= max(need, 1):
            out.append((i, j))
        i = max(j, i + 1)
    return out


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_finite_segments(spark, block):
    x, df = record(spark)
    for need in (1, 8):
        got = finite_segments(df, ["x"], need, block=block).collect()
        assert sorted((r.seg_start, r.seg_end) for r in got) == runs(x, need)


@pytest.mark.parametrize("block", [4, 1000])
def test_tag_segments(spark, block):
    x, df = record(spark)
    segs = finite_segments(df, ["x"], 5)
    got = tag_segments(df, segs, block=block).collect()
    want = {(i, s, e) for s, e in runs(x, 5) for i in range(s, e)}
    assert {(r.i, r.seg_start, r.seg_end) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("win,step", [(2.0, 2.0), (2.0, 1.0), (1.0, 3.0)])
def test_fixed_windows(spark, win, step):
    x, df = record(spark, 95)
    L, step_n = round(10 * win), round(10 * step)
    starts = range(0, len(x) - L + 1, step_n)
    every = fixed_windows(df, win, step, ["x"], keep_all=True).collect()
    assert sorted(r.source_start_index for r in every) == list(starts)
    kept = {r.source_start_index: r.x for r in fixed_windows(df, win, step, ["x"]).collect()}
    assert sorted(kept) == [s for s in starts if np.isfinite(x[s:s + L]).all()]
    for s, v in kept.items():
        np.testing.assert_array_equal(v, x[s:s + L])


def test_window_length_rounds_half_to_even(spark):
    _, df = record(spark, 30, gaps=0.0, fs=2.5)
    got = fixed_windows(df, 1.0, 1.0, ["x"]).first()
    assert len(got.x) == 2


def test_resample_matches_interp(spark):
    x, df = record(spark, 16, gaps=0.0)
    for t in (5, 16, 23):
        got = df.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a")).select(
            A.resample_linear(F.col("a.x"), t).alias("y")).first().y
        want = np.interp(np.linspace(0, 1, t, endpoint=False), np.linspace(0, 1, 16, endpoint=False), x)
        np.testing.assert_allclose(got, want, atol=1e-12)


def upfirdn(x, up, down, taps):
    half, out = len(taps) // 2, []
    for m in range(-(-len(x) * up // down)):
        out.append(sum(x[k] * taps[half + m * down - k * up] for k in range(len(x))
                       if 0 <= half + m * down - k * up < len(taps)))
    return out


@pytest.mark.parametrize("fs_out", [5.0, 25.0, 8.0])
def test_polyphase_in_blocks(spark, fs_out):
    x, df = record(spark, 90, gaps=0.02)
    segs = finite_segments(df, ["x"], 5)
    got = S.resample_polyphase(tag_segments(df, segs), ["x"], 10.0, fs_out, block=8).collect()
    up, down = S.rational_rates(10.0, fs_out)
    taps = S.polyphase_taps(up, down)
    assert sum(taps) == pytest.approx(up)
    for s, e in runs(x, 5):
        mine = [r.x for r in sorted((r for r in got if r.seg_start == s), key=lambda r: r.m)]
        np.testing.assert_allclose(mine, upfirdn(x[s:e], up, down, taps), atol=1e-9)


def test_derivatives_and_zscore(spark):
    x, df = record(spark, 120)
    segs = finite_segments(df, ["x"], 4)
    tagged = tag_segments(df, segs)
    d = {r.i: (r.vpg, r.apg, r.jpg) for r in S.derivatives(tagged, "x", block=7).collect()}
    z = {r.i: r.z for r in S.zscore(tagged, "x", "z", block=9).collect()}
    for s, e in runs(x, 4):
        v = np.gradient(x[s:e])
        a = np.gradient(v)
        np.testing.assert_allclose([d[i] for i in range(s, e)],
                                   np.column_stack([v, a, np.gradient(a)]), atol=1e-9)
        np.testing.assert_allclose([z[i] for i in range(s, e)],
                                   (x[s:e] - x[s:e].mean()) / x[s:e].std(), atol=1e-9)


def both_ways(x, w):
    """Boxcar forward and backward over the odd extension, each pass starting settled."""
    pad = 3 * w
    ext = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]]
    def run(y):
        y = np.r_[np.full(w - 1, y[0]), y]
        return np.array([y[i:i + w].mean() for i in range(len(y) - w + 1)])
    return run(run(ext)[::-1])[::-1][pad:-pad]


def test_smoothing(spark):
    x, df = record(spark, 150, gaps=0.03)
    tagged = tag_segments(df, finite_segments(df, ["x"], 4))
    got = {r.i: r.y for r in S.smooth_zero_phase(tagged, "x", "y", 4, block=11).collect()}
    want = {}
    for s, e in runs(x, 4):
        if e - s > 12:
            want.update(zip(range(s, e), both_ways(x[s:e], 4)))
    assert set(got) == set(want)
    np.testing.assert_allclose([got[i] for i in want], list(want.values()), atol=1e-9)


def test_flat_segments(spark):
    df = spark.createDataFrame([(1, i, 1.0, 5.0) for i in range(6)],
                               "record_id int, i bigint, fs double, x double")
    t = tag_segments(df, finite_segments(df, ["x"], 2))
    assert {r.z for r in S.zscore(t, "x", "z", "zero").collect()} == {0.0}
    assert S.zscore(t, "x", "z", "drop").count() == 0
    flat = spark.createDataFrame([([3.0, 3.0],), ([1.0, 3.0],)], "x array<double>")
    assert [r.u for r in flat.select(A.unit_range("x").alias("u")).collect()] == [None, [-1.0, 1.0]]


def test_slice_bounds(spark):
    df = assign_index(spark.range(10).selectExpr("'test' as split", "id"), ["id"])
    assert sorted(r.id for r in slice_windows(df, "memmap_index", 7).collect()) == [7, 8, 9]
    for start, limit in ((10, None), (8, 5), (-1, 2), (0, 0)):
        with pytest.raises(ValueError):
            slice_windows(df, "memmap_index", start, limit)


def test_minmax_needs_a_span(spark):
    df = spark.createDataFrame([("train", [1.0, 1.0])], "split string, x array<double>")
    with pytest.raises(Exception, match="span"):
        S.apply_minmax(df, S.fit_minmax(df, ["x"]), ["x"]).collect()


def test_windows_from_blocks(spark, monkeypatch):
    """Overlapping, touching and spaced windows over several blocks, with samples that are not there."""
    rng = np.random.default_rng(4)
    here = np.flatnonzero(rng.random(400) > 0.02)
    x = rng.normal(size=400)
    x[rng.random(400) < 0.02] = np.nan
    rows = [(rec, int(i), 10.0, float(x[i])) for rec, at in ((1, here), (2, np.arange(400))) for i in at]
    df = spark.createDataFrame(rows, "record_id int, i bigint, fs double, x double")
    monkeypatch.setattr(windows, "WINDOW_BLOCK", 32)
    for win, step in ((1.0, 0.3), (2.0, 2.0), (0.5, 1.5), (9.0, 4.0)):
        size, hop = round(win * 10), round(step * 10)
        got = {(r.record_id, r.window_index): (r.n_bad, r.x) for r in
               windows.fixed_windows(df, win, step, ["x"], ["record_id"], keep_all=True).collect()}
        want = {(rec, k) for rec, at in ((1, here), (2, np.arange(400))) for k in range(400)
                if np.isin(np.arange(k * hop, k * hop + size), at).all()}
        assert set(got) == want
        for (rec, k), (n_bad, values) in got.items():
            part = x[k * hop:k * hop + size]
            np.testing.assert_array_equal(np.array(values, float), part)
            assert n_bad == np.isnan(part).sum()


def test_range_index_is_row_number(spark):
    df = spark.range(1000).selectExpr("case when id % 3 = 0 then 'b' else 'a' end as g", "id * 7919 % 1009 as v", "id")
    got = range_index(df, ["g"], ["v", "id"], "n").collect()
    for g in "ab":
        rows = sorted((r.v, r.id, r.n) for r in got if r.g == g)
        assert [r[2] for r in rows] == list(range(len(rows)))
    assert len(got) == 1000
