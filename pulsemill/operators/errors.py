"""Error metrics."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsemill.functions import fixed
from pulsemill.functions.numeric import guarded_corr, is_finite
from pulsemill.operators.peaks import beat_segments, beat_stats, detect_peaks


def waveform_metrics(points: DataFrame, by=(), true="y_true", pred="y_pred") -> DataFrame:
    """n, MAE, RMSE and correlation over pairs finite on both sides.

    One aggregation; partial sums are combined before the shuffle, so a group of any
    size is fine.
    """
    x, y = F.col(true), F.col(pred)
    both = is_finite(true) & is_finite(pred)
    e = F.when(both, y - x)
    xs, ys = F.when(both, x), F.when(both, y)
    aggs = [
        F.count(e).alias("n_points"), F.avg(F.abs(e)).alias("waveform_mae"),
        F.sqrt(F.avg(e * e)).alias("waveform_rmse"),
        guarded_corr(F.covar_pop(xs, ys), F.var_pop(xs), F.var_pop(ys)).alias("waveform_corr"),
    ]
    return points.groupBy(*by).agg(*aggs) if by else points.agg(*aggs)


def bhs_grade(w5: Column, w10: Column, w15: Column) -> Column:
    def at_least(a, b, c):
        return (w5 >= a) & (w10 >= b) & (w15 >= c)
    return (F.when(w5.isNull(), F.lit(None).cast("string"))
            .when(at_least(60.0, 85.0, 95.0), "A").when(at_least(50.0, 75.0, 90.0), "B")
            .when(at_least(40.0, 65.0, 85.0), "C").otherwise("D"))


def scalar_error_summary(errors: DataFrame, col: str = "error", by=()) -> DataFrame:
    """n, MAE, RMSE, bias, deviation, limits of agreement, AAMI pass and BHS grade."""
    e = F.when(is_finite(col), F.col(col))
    aggs = [F.count(e).alias("n_beats"), F.avg(F.abs(e)).alias("mae"),
            F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
            F.stddev_pop(e).alias("std")]
    for k in (5, 10, 15):
        aggs.append((F.avg(F.when(e.isNotNull(), (F.abs(e) <= float(k)).cast("double")))
                     * 100.0).alias(f"bhs_within_{k}"))
    out = errors.groupBy(*by).agg(*aggs) if by else errors.agg(*aggs)
    return out.withColumns({
        "loa_low": F.col("bias") - 1.96 * F.col("std"),
        "loa_high": F.col("bias") + 1.96 * F.col("std"),
        "aami_mean_error": F.col("bias"), "aami_std_error": F.col("std"),
        "aami_compliant": (F.abs("bias") <= 5.0) & (F.col("std") <= 8.0),
        "bhs_grade": bhs_grade(F.col("bhs_within_5"), F.col("bhs_within_10"),
                               F.col("bhs_within_15")),
    })


def scalar_errors_long(preds: DataFrame, keep=()) -> DataFrame:
    """One row per prediction and pressure: metric, error."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"),
                               (F.col(f"{m}_pred") - F.col(f"{m}_true")).alias("error"))
                      for m in fixed.SCALAR_METRICS])
    return preds.select(*keep, F.explode(pairs).alias("__e")).select(
        *keep, F.col("__e.metric").alias("metric"), F.col("__e.error").alias("error"))


def beat_errors(windows: DataFrame, window_seconds: float, keys: list, true="y_true",
                pred="y_pred") -> DataFrame:
    """Beat-wise errors: beats are cut on the truth and measured on both arrays.

    Each side first drops its own beats with gaps; what remains is paired by position.
    """
    rows = windows.withColumn("__seg", beat_segments(
        detect_peaks(true, window_seconds), F.size(true)))
    # Windows without beats fall out when the beats are exploded; a filter here would be pushed
    # below and evaluate the peaks a second time.
    return beat_errors_from(rows.withColumn("beats", _paired_beats(true, pred, "__seg")), keys)


def _paired_beats(true, pred, segments) -> Column:
    return F.arrays_zip(beat_stats(true, segments).alias("t"), beat_stats(pred, segments).alias("p"))


def beat_errors_from(windows: DataFrame, keys: list) -> DataFrame:
    """One row per beat and pressure from the `beats` column of `window_statistics`."""
    beats = windows.select(*keys, F.posexplode("beats").alias("beat", "__b")).where(
        F.col("__b.t").isNotNull() & F.col("__b.p").isNotNull())
    per_metric = F.array(*[F.struct(F.lit(m).alias("metric"),
                                    (F.col(f"__b.p.{m}") - F.col(f"__b.t.{m}")).alias("error"))
                           for m in fixed.SCALAR_METRICS])
    return beats.select(*keys, "beat", F.explode(per_metric).alias("__e")).select(
        *keys, "beat", F.col("__e.metric").alias("metric"), F.col("__e.error").alias("error"))


def max_shift_samples(shift_ms: float, length: int, window_seconds: float) -> int:
    return min(int(round(shift_ms / 1000.0 * length / window_seconds)), max(0, length - 1))


SHIFT_CELLS = 1 << 19


def _similar_lengths(size):
    """Row groups by length, so that padding one long window does not widen all others."""
    order, start = np.argsort(size, kind="stable"), 0
    while start < order.size:
        stop = start + 1
        while stop < order.size and (stop + 1 - start) * size[order[stop]] <= SHIFT_CELLS:
            stop += 1
        yield order[start:stop]
        start = stop


def _best_shift(t, p, size, shift_ms, window_seconds, shift_samples):
    """Smallest MAE and RMSE per row; rows shorter than the longest are padded with gaps."""
    n, width = len(t), int(size.max())
    yt, yp = np.full((n, width), np.nan), np.full((n, width), np.nan)
    for r, (a, b) in enumerate(zip(t, p)):
        yt[r, :len(a)], yp[r, :len(b)] = a, b
    yt[~np.isfinite(yt)], yp[~np.isfinite(yp)] = np.nan, np.nan
    reach = (np.rint(shift_ms / 1000.0 * size / window_seconds) if shift_samples is None
             else np.full(n, shift_samples)).astype(np.int64)
    reach = np.minimum(reach, np.maximum(size - 1, 0))
    best = np.full((n, 2), np.inf)
    for s in range(-int(reach.max()), int(reach.max()) + 1):
        d = yp[:, max(0, s):width - max(0, -s)] - yt[:, max(0, -s):width - max(0, s)]
        ok = np.isfinite(d)
        count = ok.sum(axis=1)
        d = np.where(ok, d, 0.0)
        safe = np.maximum(count, 1)
        here = np.column_stack([np.abs(d).sum(axis=1) / safe,
                                np.sqrt((d * d).sum(axis=1) / safe)])
        use = (count > 0) & (reach >= abs(s))
        best = np.where(use[:, None], np.minimum(best, here), best)
    return best


def _pair_sums(t, p):
    """Count and sums over pairs finite on both sides."""
    x, y = np.asarray(t, dtype=np.float64), np.asarray(p, dtype=np.float64)
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    e = y - x
    return (x.size, np.abs(e).sum(), (e * e).sum(), x.sum(), y.sum(), (x * x).sum(),
            (y * y).sum(), (x * y).sum())


PAIR_SUMS = ["n", "abs", "sq", "x", "y", "xx", "yy", "xy"]


def _row_statistics(windows: DataFrame, shift_ms, window_seconds, true, pred, shift_samples):
    """The struct column with best-shift errors and pair sums of each window."""
    fields = ["mae", "rmse", *PAIR_SUMS]

    @F.pandas_udf("struct<" + ", ".join(f"{f}: double" for f in fields) + ">")
    def measure(t: pd.Series, p: pd.Series) -> pd.DataFrame:
        size = np.array([len(a) for a in t], dtype=np.int64)
        both = np.full((len(t), 2), np.inf)
        for rows in _similar_lengths(size):
            both[rows] = _best_shift(t.iloc[rows], p.iloc[rows], size[rows], shift_ms,
                                     window_seconds, shift_samples)
        sums = np.array([_pair_sums(a, b) for a, b in zip(t, p)]).reshape(len(t), len(PAIR_SUMS))
        out = np.hstack([both, sums])
        return pd.DataFrame(out.astype(object), columns=fields).where(np.isfinite(out), None)

    # Marked so that no later filter on the result is pushed below it, which would run it twice.
    measure = measure.asNondeterministic()
    return measure(F.col(true).cast("array<double>"), F.col(pred).cast("array<double>"))


def min_shift_errors(windows: DataFrame, shift_ms: float, window_seconds: float,
                     true="y_true", pred="y_pred", shift_samples: int = None) -> DataFrame:
    """Smallest MAE and smallest RMSE of each window over shifts of at most +-K samples.

    A shift s pairs true[i] with pred[i + s]. The two minima are taken independently.
    Work stays inside the row: no self-join and no shuffle.
    """
    made = _row_statistics(windows, shift_ms, window_seconds, true, pred, shift_samples)
    return (windows.withColumn("__s", made)
            .withColumns({"min_mae": F.col("__s.mae"), "min_rmse": F.col("__s.rmse")})
            .drop("__s"))


def window_statistics(windows: DataFrame, keys: list, shift_ms: float, window_seconds: float,
                      true="y_true", pred="y_pred", shift_samples: int = None) -> DataFrame:
    """Everything the patient metrics need from a window, in one pass over the arrays.

    Best-shift errors, sums over finite pairs, and the paired beats. The result is small:
    a few numbers per window and per beat.
    """
    made = _row_statistics(windows, shift_ms, window_seconds, true, pred, shift_samples)
    rows = windows.withColumns({"__s": made, "__seg": beat_segments(
        detect_peaks(true, window_seconds), F.size(true))})
    return rows.select(*keys, F.col("__s.mae").alias("min_mae"), F.col("__s.rmse").alias("min_rmse"),
                       *[F.col(f"__s.{c}").alias(f"sum_{c}") for c in PAIR_SUMS],
                       _paired_beats(true, pred, "__seg").alias("beats"))


def reduce_samples(samples: DataFrame, by: list, col: str, how: str = "mean") -> DataFrame:
    """Collapse the repeated samples of each point: mean, or lower median."""
    if how == "mean":
        return samples.groupBy(*by).agg(F.avg(col).alias("reduced"))
    if how != "median":
        raise ValueError("how must be 'mean' or 'median'")
    return samples.groupBy(*by).agg(
        F.expr(f"percentile_disc(0.5) within group (order by `{col}`)").alias("reduced"))
