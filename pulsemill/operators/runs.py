"""Validation metrics, masked label errors, weighted losses, epoch history."""

from pyspark.sql import DataFrame, functions as F

from pulsemill.functions import fixed
from pulsemill.functions.numeric import is_finite
from pulsemill.operators.quantiles import exact_quantiles


def validation_metrics(points: DataFrame, by=(), window: str = "window_id", true="y_true",
                       pred="y_pred", min_points: int = 6) -> DataFrame:
    """MAE and RMSE weighted by points; correlation and loss averaged over windows.

    Windows with fewer than `min_points` usable points are left out.
    """
    both = is_finite(true) & is_finite(pred)
    rows = points.where(both)
    x, y = F.col(true), F.col(pred)
    per = rows.groupBy(*by, window).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(y - x)).alias("ae"),
        F.sum((y - x) * (y - x)).alias("se"), F.covar_pop(x, y).alias("c"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy")).where(F.col("n") >= min_points)
    n = F.col("n")
    corr = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c") * n / F.sqrt(
        F.col("vx") * n * F.col("vy") * n + 1e-12)))
    aggs = [F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_points"),
            F.try_divide(F.sum("ae"), F.sum("n")).alias("val_mae"),
            F.sqrt(F.try_divide(F.sum("se"), F.sum("n"))).alias("val_rmse"),
            F.avg(corr).alias("val_corr"), F.avg(F.col("se") / n).alias("val_loss")]
    return per.groupBy(*by).agg(*aggs) if by else per.agg(*aggs)


def masked_label_mae(df: DataFrame, labels: dict, by=()) -> DataFrame:
    """MAE and count per label, each with its own validity.

    `labels`: name -> (true column, predicted column, validity condition).
    """
    aggs = []
    for name, (true, pred, valid) in labels.items():
        ok = valid & is_finite(true) & is_finite(pred)
        aggs += [F.avg(F.when(ok, F.abs(F.col(pred) - F.col(true)))).alias(f"{name}_mae"),
                 F.count_if(ok).alias(f"{name}_n")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def masked_tau_mae(df: DataFrame, obs_log: str, pred_tau: str, valid) -> DataFrame:
    """Decay time errors in log seconds and in seconds, with the count."""
    pred_log = F.ln(F.greatest(F.col(pred_tau), F.lit(1e-4)))
    ok = valid & is_finite(obs_log) & is_finite(pred_log)
    return df.agg(
        F.avg(F.when(ok, F.abs(pred_log - F.col(obs_log)))).alias("tau_log_mae"),
        F.avg(F.when(ok, F.abs(F.exp(pred_log) - F.exp(obs_log)))).alias("tau_mae"),
        F.count_if(ok).alias("tau_n"))


def decay_tau(samples: DataFrame, key: str = "segment_id") -> DataFrame:
    """ln of the decay time per segment from the log-pressure slope.

    Needs at least 3 samples, all more than 1e-6 above the asymptote, and a falling slope;
    otherwise NULL. Columns: i, dt, p, p_inf.
    """
    above = F.col("p") - F.col("p_inf")
    t = F.col("i") * F.col("dt")
    safe = F.when(above > 1e-6, above)
    out = samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_samples"), F.min(above).alias("__min"),
        F.count("p").alias("__np"), F.regr_slope(F.ln(safe), t).alias("__slope"))
    ok = ((F.col("n_samples") >= 3) & (F.col("__np") == F.col("n_samples"))
          & (F.col("__min") > 1e-6) & (F.col("__slope") < 0))
    return out.select(key, "n_samples", F.when(ok, F.ln(-1.0 / F.col("__slope"))).alias("log_tau"))


def _weight(df_weight, df_se):
    ok = is_finite(df_weight) & is_finite(df_se) & (F.col(df_se) > 0) & (F.col(df_weight) > 0)
    return ok, F.col(df_weight) / (F.col(df_se) * F.col(df_se))


def tau_loss(df: DataFrame, valid, obs="obs_log", pred="pred_log", se="se",
             weight="weight") -> DataFrame:
    """Inverse-variance weighted squared error of the log decay time, with means in seconds."""
    usable, w = _weight(weight, se)
    ok = valid & usable & is_finite(obs) & is_finite(pred)
    e = F.col(pred) - F.col(obs)
    ws = F.sum(F.when(ok, w))
    return df.agg(
        F.coalesce(F.try_divide(F.sum(F.when(ok, w * e * e)), ws), F.lit(0.0)).alias("tau_loss"),
        F.count_if(ok).alias("tau_n"),
        F.avg(F.when(ok, F.exp(obs))).alias("tau_obs_mean"),
        F.avg(F.when(ok, F.exp(pred))).alias("tau_pred_mean"))


def tau_shape_loss(segments: DataFrame, valid, beta: float, window: str = "window_id",
                   obs="obs_log", pred="seg_log", se="se", weight="weight") -> DataFrame:
    """Smooth-L1 error of segment decay times, averaged per window, then weighted.

    Segments without a fitted time are skipped.
    """
    usable, w = _weight(weight, se)
    rows = segments.where(valid & usable & is_finite(obs) & is_finite(pred))
    d = F.abs(F.col(pred) - F.col(obs))
    smooth = F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)
    per = rows.groupBy(window).agg(F.avg(smooth).alias("l"), F.avg(w).alias("w"),
                                   F.avg(F.exp(pred)).alias("t"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("l")), F.sum("w")),
                   F.lit(0.0)).alias("shape_loss"),
        F.count(F.lit(1)).alias("n_windows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_segments"), F.avg("t").alias("tau_mean"))


def epoch_rollup(batches: DataFrame, averaged: list, counted: list, weighted: dict,
                 epoch: str = "epoch") -> DataFrame:
    """Per epoch: counts summed, other values averaged over batches, and means weighted by
    their own count (NULL when the count is 0). `weighted`: value column -> count column."""
    aggs = [F.count(F.lit(1)).alias("n_batches")]
    aggs += [F.avg(c).alias(c) for c in averaged]
    aggs += [F.sum(c).alias(c) for c in counted]
    for value, n in weighted.items():
        some = F.col(n) > 0
        aggs.append(F.try_divide(F.sum(F.when(some, F.col(value) * F.col(n))),
                                 F.sum(F.when(some, F.col(n)))).alias(value))
    return batches.groupBy(epoch).agg(*aggs)


def best_epoch(history: DataFrame, metric: str, eligible=None, epoch: str = "epoch") -> DataFrame:
    """Best finite, eligible epoch; the earliest on ties; direction follows the metric name."""
    ok = is_finite(metric) if eligible is None else is_finite(metric) & eligible
    score = F.col(metric) if metric in fixed.LOWER_IS_BETTER else -F.col(metric)
    pick = F.min(F.struct(score.alias("s"), F.col(epoch).alias("e"), F.col(metric).alias("v")))
    return history.where(ok).agg(pick.alias("__b")).select(
        F.lit(metric).alias("metric"), F.col("__b.e").alias("best_epoch"),
        F.col("__b.v").alias("best_score"))


def param_summary(df: DataFrame, col: str, by: list) -> DataFrame:
    """Mean and 5th, 50th, 95th percentile per group."""
    q = exact_quantiles(df, by, col, {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    mean = df.where(is_finite(col)).groupBy(*by).agg(F.avg(col).alias("mean"))
    return mean.join(q, by)
