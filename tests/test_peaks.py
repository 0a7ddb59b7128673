"""Peaks against a plain definition, whole and in small blocks."""

import numpy as np
import pytest

from pulsemill.operators import blocks as B, peak_rules as R, peaks as P


def plain_peaks(x, distance, prominence):
    """By definition: flat tops, greedy thinning from the highest, then both valleys."""
    n, tops, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < n and x[j + 1] < x[i]:
            tops.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(tops, key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        left = p
        while left > 0 and x[left - 1] <= x[p]:
            left -= 1
        right = p
        while right < n - 1 and x[right + 1] <= x[p]:
            right += 1
        if x[p] - max(min(x[left:p + 1]), min(x[p:right + 1])) >= prominence:
            out.append(p)
    return out


def signals():
    rng = np.random.default_rng(5)
    for k in range(60):
        n = int(rng.integers(8, 120))
        kind = k % 4
        if kind == 0:
            yield rng.normal(size=n)
        elif kind == 1:
            yield rng.integers(0, 4, size=n).astype(float)
        elif kind == 2:
            yield np.sin(np.arange(n) / 5.0) + 0.1 * rng.normal(size=n)
        else:
            yield np.repeat(rng.integers(0, 3, size=n // 4 + 2), 4).astype(float)


def test_find_peaks_matches_definition():
    for x in signals():
        for d in (1, 2, 5):
            for prom in (1e-6, 0.5):
                found, heights = P.find_peaks(x, d, prom)
                assert found == plain_peaks(x, d, prom) and heights == [x[p] for p in found]


def test_reach_says_what_lies_beyond():
    """A peak of height h, coming from the left, finds a value `prom` lower before a higher one."""
    for x in signals():
        for prom in (0.4, 1.5):
            limit = R.reach(R.piece_extremes(x)[2], prom)
            for h in np.linspace(x.min() - 1, x.max() + 2, 40):
                event = next((v for v in x if v > h or v <= h - prom), None)
                if event is not None:
                    assert (h >= limit) == (event <= h - prom)
                else:
                    assert x.max() <= h < limit


def test_border_tables_agree_on_the_greedy_choice():
    rng = np.random.default_rng(7)
    for k in range(300):
        n, apart, size = int(rng.integers(20, 90)), int(rng.integers(2, 7)), int(rng.integers(7, 15))
        pos = np.sort(rng.choice(np.arange(n), int(rng.integers(1, n // 2)), replace=False))
        h = rng.integers(0, [1, 3, 50][k % 3], len(pos)).astype(float) if k % 4 else pos.astype(float)
        kept = []
        for j in sorted(range(len(pos)), key=lambda j: (-h[j], -pos[j])):
            if all(abs(pos[j] - q) >= apart for q in kept):
                kept.append(int(pos[j]))
        blocks = [[(int(p), float(v)) for p, v in zip(pos, h) if s <= p < s + size] for s in range(0, n, size)]
        state = [[0] * len(b) for b in blocks]

        def zones(i):
            near = lambda j, cond: ([{"pos": p, "h": v, "state": s} for (p, v), s in zip(blocks[j], state[j]) if cond(p)]
                                    if 0 <= j < len(blocks) else [])
            return near(i - 1, lambda p: p >= i * size - apart), near(i + 1, lambda p: p < (i + 1) * size + apart)

        def args(i):
            return ([p for p, _ in blocks[i]], [v for _, v in blocks[i]], state[i], *zones(i), apart)

        state = [R.settle(*args(i)) for i in range(len(blocks))]
        left = [i for i in range(len(blocks)) if 0 in state[i]]
        for run in np.split(left, np.flatnonzero(np.diff(left) != 1) + 1) if left else []:
            run = run.tolist()
            ends = R.agree([R.border_table(*args(i), i * size, (i + 1) * size) for i in run])
            new = [R.settled_with(*args(i), a, b) for i, (a, b) in zip(run, ends)]
            for i, x in zip(run, new):
                state[i] = x
        got = [p for b, st in zip(blocks, state) for (p, _), s in zip(b, st) if s == 1]
        assert got == sorted(kept)


def segments_and_peaks(records, spans, distance, prom):
    rows, segs, want = [], [], set()
    for rec, x in enumerate(records):
        rows += [(rec, i, 10.0, float(v)) for i, v in enumerate(x)]
        for s, e in spans:
            e = min(e, len(x))
            segs.append((rec, s, e))
            seg = x[s:e]
            if seg.std() > 1e-12:
                z = (seg - seg.mean()) / seg.std()
                want |= {(rec, "up", s + p) for p in plain_peaks(z, distance, prom)}
                want |= {(rec, "down", s + p) for p in plain_peaks(-z, distance, prom)}
    return rows, segs, want


def recordings(rng, n):
    x = np.cumsum(rng.normal(size=n))
    x[n // 3:n // 3 + 60] = x.max() + 1
    y = np.sin(np.arange(n) / 3.0) * (1 + 5 * (np.arange(n) % 97 > 80))
    ramp = np.arange(n) * 0.1 + (np.arange(n) % 2)                        # every peak waits for the next one
    flat = np.full(n, 2.0)
    flat[3], flat[-4] = 9.0, 0.0                                           # a flat stretch over all blocks
    flat[n // 2:n // 2 + 2] = 2.05
    steps = np.repeat(rng.integers(0, 5, n // 7 + 1), 7)[:n].astype(float)
    low = 0.01 * rng.normal(size=n)                                        # ripple far below the prominence
    low[5], low[n // 2], low[-6] = 3.0, -3.0, 4.0
    return [x, y, ramp, flat, steps, low, rng.normal(size=n), np.ones(n), ramp[::-1].copy()]


@pytest.mark.parametrize("block,n", [(4, 200), (1024, 200), (8, 420)])
def test_segment_peaks_in_blocks_equal_whole_segments(spark, block, n):
    """Blocks are never exceeded: a flat stretch of 50 blocks and a ramp over all of them included."""
    records = recordings(np.random.default_rng(3), n)
    rows, segs, want = segments_and_peaks(records, ((0, 40), (45, n)), 3, 0.3)
    samples = spark.createDataFrame(rows, "record_id int, i bigint, fs double, x double")
    segments = spark.createDataFrame(segs, "record_id int, seg_start bigint, seg_end bigint")
    packed = B.pack_blocks(samples, ["x"], ["record_id"], block)
    assert max(len(r.i) for r in packed.collect()) <= block
    got = P.segment_peaks(samples, segments, {"up": ("x", 0.3, False), "down": ("x", 0.3, True)}, 0.3, block=block)
    got = {(r.record_id, r.kind, r.peak) for r in got.collect()}
    assert got == want


def test_finite_pieces_and_moments(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=100) + 1e6, rng.normal(size=100)
    x[[10, 37, 38]], y[[50, 64]] = np.nan, np.inf
    i = np.delete(np.arange(100), [70, 71])  # two samples are not there
    rows = [(0, int(k), 4.0, float(x[k]), float(y[k])) for k in i] + [(1, k, 4.0, 5.0, 5.0) for k in range(3)]
    df = spark.createDataFrame(rows, "record_id int, i bigint, fs double, x double, y double")
    from pyspark.sql import functions as F
    for block in (8, 1000):
        packed = B.pack_blocks(df, ["x", "y"], ["record_id"], block)
        pieces = B.finite_pieces(packed, ["x", "y"], ["record_id"], F.col("fs") * 1.5, block)
        got = {(r.seg_start, r.seg_end) for r in B.segments_of(pieces, ["record_id"]).collect()}
        assert got == {(0, 10), (11, 37), (39, 50), (51, 64), (72, 100)}
        for r in pieces.collect():
            a, b = r.seg_start, r.seg_end
            assert r["__m_x"] == pytest.approx(x[a:b].mean(), abs=1e-7) and r["__sd_y"] == pytest.approx(y[a:b].std(), rel=1e-9)


def test_span_values(spark):
    x = np.random.default_rng(2).normal(size=50)
    df = spark.createDataFrame([(0, k, 4.0, float(v)) for k, v in enumerate(x)], "record_id int, i bigint, fs double, x double")
    spans = spark.createDataFrame([(0, 3, 4), (0, 4, 41), (0, 41, 50)], "record_id int, start bigint, stop bigint")
    for block in (7, 100):
        got = B.span_values(B.pack_blocks(df, ["x"], ["record_id"], block), spans, "x", ["record_id"], block).collect()
        assert len(got) == 3
        for r in got:
            v = x[r.start:r.stop]
            assert (r.highest, r.lowest) == (v.max(), v.min()) and r.mean == pytest.approx(v.mean(), rel=1e-12)


def test_window_peaks_need_eight_finite_samples(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0]),
                                (2, [0.0, 5.0, 0.0, 5.0, 0.0, 5.0, 0.0, None]),
                                (3, [0.0, 5.0, 0.0, 5.0, 0.0, 5.0, 0.0, 0.0])],
                               "k int, x array<double>")
    got = {r.k: r.p for r in df.select("k", P.detect_peaks("x", 8.0).alias("p")).collect()}
    assert got == {1: [], 2: [], 3: [1, 3, 5]}


def test_beats_and_stats(spark):
    x = [0.0, 1.0, 5.0, 1.0, 0.0, 1.0, 7.0, 1.0, 0.0]
    df = spark.createDataFrame([(x, [2, 6])], "x array<double>, p array<bigint>")
    from pyspark.sql import functions as F
    row = df.withColumn("s", P.beat_segments("p", F.size("x"))).withColumn(
        "b", P.beat_stats("x", "s")).first()
    assert [(s.start, s.end, s.peak) for s in row.s] == [(0, 4, 2), (4, 9, 6)]
    assert [(b.sbp, b.dbp) for b in row.b] == [(5.0, 0.0), (7.0, 0.0)]
    assert row.b[0].map == pytest.approx(1.75)
