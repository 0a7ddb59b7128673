"""Zero-phase recursive filters over segments of any length.

A recursive filter is a linear recurrence: what it does to a block is an affine map of the few numbers it
carries from sample to sample. So every block is run from a state of zero, which gives the map's
constant part; the maps of a segment's blocks are composed in order, one small row per block, which gives
the state each block starts with; and every block is run once more with that state. The backward
pass is the same from the other end. Inside a block the same is done with shorter parts, those of
many blocks side by side. A segment of one block needs no maps.
"""

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsemill.sources.storage import materialize, stored

BLOCK, PART, SAMPLES_AT_ONCE = 32768, 64, 1_000_000
BAND, ORDER, STOP_DB = (0.5, 12.0), 4, 20.0


@functools.lru_cache(maxsize=256)
def band_pass_sections(fs: float, low: float, high: float, order: int = ORDER, stop_db: float = STOP_DB):
    """Second-order sections (b0, b1, b2, a1, a2) of a Chebyshev band-pass of the second kind, by the bilinear
    map; None where the band does not fit below half the rate."""
    if not 0 < low < high < fs / 2:
        return None
    m = np.arange(-order + 1, order, 2)
    width = np.arcsinh(np.sqrt(10 ** (stop_db / 10) - 1)) / order
    zeros = -np.conj(1j / np.sin(m[m != 0] * np.pi / (2 * order)))
    poles = -np.exp(1j * np.pi * m / (2 * order))
    poles = 1 / (np.sinh(width) * poles.real + 1j * np.cosh(width) * poles.imag)
    gain = np.real(np.prod(-poles) / np.prod(-zeros))
    # Low-pass to band-pass, at frequencies bent for the bilinear map.
    edges = 4 * np.tan(np.pi * np.array([low, high]) / fs)
    band, centre = edges[1] - edges[0], np.sqrt(edges[0] * edges[1])

    def both(x):
        x = x * band / 2
        root = np.sqrt(x * x - centre * centre + 0j)
        return np.r_[x + root, x - root]

    more = len(poles) - len(zeros)
    gain *= band ** more
    zeros, poles = np.r_[both(zeros), np.zeros(more)], both(poles)
    gain *= np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    zeros = np.r_[(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))]
    poles = (4 + poles) / (4 - poles)
    # One section per pair of conjugates, zeros beside the poles next to them.
    p = sorted(poles[poles.imag > 0], key=lambda x: -abs(x))
    z = list(zeros[zeros.imag > 0])
    out = []
    for x in p:
        near = z.pop(int(np.argmin([abs(x - y) for y in z])))
        out.append([1.0, -2 * near.real, abs(near) ** 2, -2 * x.real, abs(x) ** 2])
    out[0][:3] = [gain * b for b in out[0][:3]]
    return np.array(out)


def steady_state(sections) -> np.ndarray:
    """The state in which a constant input of one gives a constant output."""
    out, level = [], 1.0
    for b0, b1, b2, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        s2 = b2 - a2 * gain
        out += [level * (b1 - a1 * gain + s2), level * s2]
        level *= gain
    return np.array(out)


def _steps(sections, x, state):
    """Run rows of x (time along the first axis) from a state of shape (2 * sections, columns)."""
    s, y = [r.copy() for r in state], np.empty_like(x)
    for t in range(len(x)):
        v = x[t]
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            w = b0 * v + s[2 * k]
            s[2 * k] = b1 * v - a1 * w + s[2 * k + 1]
            s[2 * k + 1] = b2 * v - a2 * w
            v = w
        y[t] = v
    return y, np.array(s)


def carried(sections, n: int) -> np.ndarray:
    """The matrix that takes a state over n samples of zero input."""
    size = 2 * len(sections)
    _, one = _steps(sections, np.zeros((1, size)), np.eye(size))
    return np.linalg.matrix_power(one, n)


def run_blocks(sections, xs, states):
    """[(y, state after it)] of the recurrence over several blocks, all parts of all blocks side by side."""
    n, size = np.array([len(x) for x in xs]), 2 * len(sections)
    state = np.array(states, float).reshape(len(xs), size).T.copy()
    parts, ys = n // PART, [np.empty(k) for k in n]
    if parts.any():
        cols = np.concatenate([x[:p * PART] for x, p in zip(xs, parts)]).reshape(-1, PART).T
        zero, ends = _steps(sections, np.ascontiguousarray(cols), np.zeros((size, cols.shape[1])))
        over, starts, first = carried(sections, PART), np.empty_like(ends), np.cumsum(parts) - parts
        order = np.argsort(-parts, kind="stable")
        for p in range(parts.max()):
            live = order[:np.count_nonzero(parts > p)]
            at = first[live] + p
            starts[:, at] = state[:, live]
            state[:, live] = over @ state[:, live] + ends[:, at]
        free, _ = _steps(sections, np.zeros((PART, size)), np.eye(size))
        whole = (zero + free @ starts).T.ravel()
        for y, k, p in zip(ys, first * PART, parts):
            y[:p * PART] = whole[k:k + p * PART]
    rest = n - parts * PART
    if rest.any():
        # Longest first, so that the blocks that still run at a step are the first columns.
        order = np.argsort(-rest, kind="stable")
        cols, s = np.zeros((rest.max(), len(xs))), state[:, order]
        for c, k in enumerate(order):
            cols[:rest[k], c] = xs[k][parts[k] * PART:]
        for step in range(len(cols)):
            live = np.count_nonzero(rest > step)
            cols[step:step + 1, :live], s[:, :live] = _steps(sections, cols[step:step + 1, :live], s[:, :live])
        for c, k in enumerate(order):
            ys[k][parts[k] * PART:] = cols[:rest[k], c]
        state[:, order] = s
    return [(y, state[:, k]) for k, y in enumerate(ys)]


def run_block(sections, x, state):
    """(y, state after it) of the recurrence over one block, its parts side by side."""
    return run_blocks(sections, [x], [state])[0]


def _at_once(rates, xs):
    """Row numbers of one rate each, of at most SAMPLES_AT_ONCE samples where one block is not longer."""
    groups = {}
    for k, rate in enumerate(rates):
        groups.setdefault(float(rate), []).append(k)
    for rate, rows in groups.items():
        held, size = [], 0
        for k in rows:
            if held and size + len(xs[k]) > SAMPLES_AT_ONCE:
                yield rate, held
                held, size = [], 0
            held.append(k)
            size += len(xs[k])
        yield rate, held


def reach_of(sections) -> int:
    """Samples that the signal is mirrored by at its ends: three times the filter's length."""
    return 3 * (2 * len(sections) + 1)


def zero_phase(sections, x):
    """Forward and backward over one whole array, with odd mirrored ends; None if it is too short."""
    n = reach_of(sections)
    if len(x) <= n:
        return None
    x = np.r_[2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2:-n - 2:-1]]
    rest = steady_state(sections)
    y, _ = run_block(sections, x, rest * x[0])
    y, _ = run_block(sections, y[::-1], rest * y[-1])
    return y[::-1][n:-n]


def _mirrored(x, first, last, n):
    head = 2 * x[0] - x[n:0:-1] if first else np.zeros(0)
    tail = 2 * x[-1] - x[-2:-n - 2:-1] if last else np.zeros(0)
    return np.r_[head, x, tail]


def _packed(tagged, cols, keys, block):
    """(keys, seg_end, __blk, first, last, fs, i and channels as arrays). Blocks count from the start of the
    segment; what is left at its end goes to the last whole block, so none is shorter than `block` but a whole segment."""
    n, k = F.col("seg_end") - F.col("seg_start"), F.col("i") - F.col("seg_start")
    last = F.greatest(F.floor(n / F.lit(block)) - 1, F.lit(0))
    blk = F.least(F.floor(k / F.lit(block)), last)
    rows = tagged.withColumns({"__blk": blk, "__last": F.least(blk, last) == last})
    made = rows.repartition(*keys, "__blk").groupBy(*keys, "seg_end", "__blk", "__last").agg(
        F.max("fs").cast("double").alias("fs"), F.sort_array(F.collect_list(F.struct("i", *cols))).alias("__d"))
    return made.select(*keys, "seg_end", "__blk", "__last", "fs", F.col("__d.i").alias("i"),
                       *[F.col("__d").getField(c).alias(c) for c in cols])


def _states(summaries: DataFrame, backward: bool, low, high) -> DataFrame:
    """(__seg, __blk, state): what every block starts with, by composing the maps of those before."""
    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__blk", ascending=not backward)
        sections = band_pass_sections(float(pdf["fs"].iloc[0]), low, high)
        state, over, out = np.array(pdf["begin"].iloc[0], float), {}, []
        for n, end in zip(pdf["n"], pdf["zero"]):
            out.append(state.tolist())
            if n not in over:
                over[n] = carried(sections, int(n))
            state = over[n] @ state + np.array(end, float)
        return pd.DataFrame({"__seg": pdf["__seg"], "__blk": pdf["__blk"], "state": out})

    return summaries.groupBy("__seg").applyInPandas(scan, "__seg string, __blk bigint, state array<double>")


def band_pass(tagged: DataFrame, col: str, out: str, keys, band=BAND, block: int = BLOCK,
              others=()) -> DataFrame:
    """(keys, seg_end, i, fs, out, others): the zero-phase band-pass of `col` along each segment, at the
    rate of the segment's `fs`. Segments too short for the mirrored ends, or of a rate too low for the
    band, are left out. Other columns named in `others` travel along."""
    keys, others, (low, high) = list(keys), list(others), band
    mirror = 3 * (4 * ORDER // 2 + 1)
    if block <= mirror:
        raise ValueError(f"blocks of {block} samples are too short for mirrored ends of {mirror}")
    n = F.col("seg_end") - F.col("seg_start")
    fit = tagged.where((n > mirror) & (F.col("fs") > 2 * high))
    packed = _packed(fit, list(dict.fromkeys([col, *others])), keys, block)
    packed = stored(packed.withColumn("__seg", F.to_json(F.struct(*keys))), "filter")

    def entered(x, blk, last, backward):
        """The block's values in the order of the pass, with mirrored ends."""
        x = np.asarray(x, float)
        return x[::-1] if backward else _mirrored(x, blk == 0, last, mirror)

    def summing(backward):
        @F.pandas_udf("struct<n: bigint, zero: array<double>, begin: array<double>>")
        def run(x: pd.Series, fs: pd.Series, blk: pd.Series, last: pd.Series) -> pd.DataFrame:
            xs, rows = [entered(a, b, z, backward) for a, b, z in zip(x, blk, last)], [None] * len(x)
            for rate, own in _at_once(fs, xs):
                sections = band_pass_sections(rate, low, high)
                rest, zero = steady_state(sections), np.zeros(2 * len(sections))
                for k, (_, end) in zip(own, run_blocks(sections, [xs[k] for k in own], [zero] * len(own))):
                    rows[k] = (len(xs[k]), end.tolist(), (rest * xs[k][0]).tolist())
            return pd.DataFrame(rows, columns=["n", "zero", "begin"])
        return run

    def running(backward):
        @F.pandas_udf("array<double>")
        def run(x: pd.Series, fs: pd.Series, blk: pd.Series, last: pd.Series, state: pd.Series) -> pd.Series:
            xs, res = [entered(a, b, z, backward) for a, b, z in zip(x, blk, last)], [None] * len(x)
            blk, last, state = blk.tolist(), last.tolist(), state.tolist()
            for rate, own in _at_once(fs, xs):
                sections = band_pass_sections(rate, low, high)
                rest = steady_state(sections)
                begin = [rest * xs[k][0] if state[k] is None else state[k] for k in own]
                for k, (y, _) in zip(own, run_blocks(sections, [xs[k] for k in own], begin)):
                    if backward:
                        y = y[::-1]
                        y = y[mirror if blk[k] == 0 else 0:len(y) - mirror if last[k] else len(y)]
                    res[k] = y
            return pd.Series(res, dtype=object)
        return run

    def passed(rows, source, backward):
        args = [source, "fs", "__blk", "__last"]
        # A segment of one block begins in the steady state of its first value; nothing else is asked.
        whole = (F.col("__blk") == 0) & F.col("__last")
        none = F.lit(None).cast("array<double>")
        alone = rows.where(whole).withColumn("__y", running(backward)(*args, none))
        rows = rows.where(~whole)
        sums = rows.select("__seg", "__blk", "fs", summing(backward)(*args).alias("__s")).select(
            "__seg", "__blk", "fs", "__s.*")
        # The pass begins in the steady state of the signal's first value, at the block it begins with.
        first = F.min_by if not backward else F.max_by
        begin = sums.groupBy("__seg").agg(first("begin", "__blk").alias("begin"))
        states = _states(sums.drop("begin").join(begin, "__seg"), backward, low, high)
        joined = rows.join(states, ["__seg", "__blk"]).withColumn("__y", running(backward)(*args, "state")).drop("state")
        return alone.unionByName(joined)

    forward = materialize(passed(packed, col, False))
    done = passed(forward, "__y", True)
    zipped = F.arrays_zip("i", F.col("__y").alias("__y"), *others)
    return done.select(*keys, "seg_end", "fs", F.explode(zipped).alias("__z")).select(
        *keys, "seg_end", "fs", F.col("__z.i").alias("i"), F.col("__z.__y").alias(out),
        *[F.col("__z").getField(c).alias(c) for c in others])
