"""The band-pass next to a plain recursion and to its own frequency response."""

import numpy as np
import pytest

from pulsemill.operators import filters as X


def plain(sections, x, state):
    s, out = np.array(state, float), []
    for v in x:
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            w = b0 * v + s[2 * k]
            s[2 * k] = b1 * v - a1 * w + s[2 * k + 1]
            s[2 * k + 1] = b2 * v - a2 * w
            v = w
        out.append(v)
    return np.array(out), s


def plain_zero_phase(sections, x):
    n = X.reach_of(sections)
    x = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2:-n - 2:-1]])
    rest = X.steady_state(sections)
    y, _ = plain(sections, x, rest * x[0])
    y, _ = plain(sections, y[::-1], rest * y[-1])
    return y[::-1][n:-n]


def gain(sections, f, fs):
    z = np.exp(-2j * np.pi * np.asarray(f) / fs)
    out = 1.0
    for b0, b1, b2, a1, a2 in sections:
        out = out * (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return np.abs(out)


@pytest.mark.parametrize("fs,low,high", [(125.0, 0.5, 12.0), (500.0, 0.5, 12.0), (4.0, 0.2, 1.5), (30.0, 0.5, 12.0)])
def test_design(fs, low, high):
    """By definition: 20 dB down at both edges and beyond, close to one between, stable."""
    s = X.band_pass_sections(fs, low, high)
    assert len(s) == 4 and (s[:, 4] < 1).all()
    assert gain(s, [low, high], fs) == pytest.approx([0.1, 0.1], rel=1e-6)
    assert (gain(s, np.linspace(0, low, 50), fs) <= 0.1 + 1e-9).all()
    assert (gain(s, np.linspace(high, fs / 2, 50), fs) <= 0.1 + 1e-9).all()
    assert gain(s, np.sqrt(low * high), fs) == pytest.approx(1.0, abs=0.05)
    assert X.band_pass_sections(20.0, 0.5, 12.0) is None


def test_steady_state_stays():
    s = X.band_pass_sections(125.0, 0.5, 12.0)
    y, _ = plain(s, np.ones(500), X.steady_state(s))
    assert np.ptp(y) < 1e-9


def test_blocks_compose_to_the_plain_recursion():
    rng = np.random.default_rng(0)
    s = X.band_pass_sections(125.0, 0.5, 12.0)
    x = np.cumsum(rng.normal(size=20_000))
    state = rng.normal(size=8)
    want, end = plain(s, x, state)
    got, last = X.run_block(s, x, state)
    assert np.abs(got - want).max() < 1e-9 * np.abs(x).max() and np.allclose(last, end, atol=1e-9 * np.abs(x).max())
    np.testing.assert_allclose(X.carried(s, 5000) @ state + X.run_block(s, x[:5000], np.zeros(8))[1],
                               X.run_block(s, x[:5000], state)[1], atol=1e-9 * np.abs(x).max())


@pytest.mark.parametrize("block", [40, 100_000])
def test_band_pass_over_blocks(spark, block):
    """Long and short segments, two rates; too short or too slow ones are left out."""
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for rec, (fs, n, start) in enumerate([(125.0, 3000, 0), (125.0, 39, 7), (60.0, 85, 3), (125.0, 27, 0), (20.0, 300, 0), (125.0, 40, 1)]):
        x = np.cumsum(rng.normal(size=n))
        rows += [(rec, start, start + n, start + k, fs, float(v), float(-v)) for k, v in enumerate(x)]
        s = X.band_pass_sections(fs, 0.5, 12.0)
        if s is not None and n > 27:
            want[rec] = (plain_zero_phase(s, x), x)
            np.testing.assert_allclose(X.zero_phase(s, x), want[rec][0], atol=1e-9 * np.abs(x).max())
    df = spark.createDataFrame(rows, "record_id int, seg_start bigint, seg_end bigint, i bigint, fs double, x double, p double")
    got = X.band_pass(df, "x", "y", ["record_id", "seg_start"], block=block, others=["p"]).toPandas()
    assert set(got["record_id"]) == set(want)
    for rec, part in got.groupby("record_id"):
        part = part.sort_values("i")
        y, x = want[rec]
        assert len(part) == len(x) and (part["p"].to_numpy() == -x).all()
        np.testing.assert_allclose(part["y"].to_numpy(), y, atol=1e-9 * max(1.0, np.abs(x).max()))


def test_many_short_blocks_take_the_steps_of_one(monkeypatch):
    rng = np.random.default_rng(5)
    s = X.band_pass_sections(4.0, 0.2, 1.5)
    xs = [rng.normal(size=n) for n in [*rng.integers(28, 150, 60), 1, X.PART, 2 * X.PART, 1000]]
    states = rng.normal(size=(len(xs), 8))
    steps, taken = X._steps, []
    monkeypatch.setattr(X, "_steps", lambda sections, x, state: taken.append(len(x)) or steps(sections, x, state))
    got = X.run_blocks(s, xs, states)
    # Python's steps do not grow with the number of blocks.
    assert sum(taken) <= 4 * X.PART
    for x, state, (y, end) in zip(xs, states, got):
        expected, after = plain(s, x, state)
        np.testing.assert_allclose(y, expected, atol=1e-9)
        np.testing.assert_allclose(end, after, atol=1e-9)
