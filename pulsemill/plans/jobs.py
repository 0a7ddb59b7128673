"""End-to-end jobs."""

from pyspark.sql import DataFrame, functions as F

from pulsemill.functions import fixed
from pulsemill.functions.arrays import pack_slots, resample_linear, unit_range
from pulsemill.operators import alignment, errors, linear, patients, quality, signals, transit
from pulsemill.operators.quantiles import exact_quantiles
from pulsemill.operators.windows import assign_index, fixed_windows, window_funnel
from pulsemill.sources.storage import materialize, stored


def transit_benchmark(samples: DataFrame, fit_splits=("train",), transform="inverse_ptt",
                      keys=("split", "subject_id", "record_id"), **extraction) -> dict:
    """Pulse-transit benchmark: extract beats, calibrate, predict, summarise.

    Returns predictions, model, summary and labelled R peaks.
    """
    used = samples.where(F.col("split").isin(*fit_splits, "test"))
    beats, labelled, feet, segments = transit.extract_beats(used, keys=keys, **extraction)
    beats = materialize(beats)
    model = materialize(transit.fit_ptt(beats.where(F.col("split").isin(*fit_splits)), transform))
    if model.first()["rank_deficient"]:
        raise ValueError("the calibration beats need varying transit times")
    preds = transit.predict_ptt(beats.where(F.col("split") == "test"), model, transform)
    summary = errors.scalar_error_summary(errors.scalar_errors_long(preds), "error", ["metric"])
    return {"predictions": preds, "model": model, "summary": summary, "labelled": labelled,
            "feet": feet, "segments": segments, "beats": beats,
            "invalid_transit_times": beats.groupBy("split").agg(F.count_if(
                transit.ptt_feature("ptt_sec", transform).isNull()).alias("n_invalid"))}


def evaluate_waveforms(windows: DataFrame, window_seconds: float, scale: float = 1.0,
                       offset: float = 0.0, keys=("window_id",)) -> tuple:
    """(pooled waveform metrics, scalar summary per pressure) of a run.

    `scale` and `offset` bring stored values back to mmHg.
    """
    if (scale, offset) != (1.0, 0.0):
        back = lambda v: v * scale + offset
        windows = windows.withColumns({c: F.transform(c, back) for c in ("y_true", "y_pred")})
    waveform = errors.waveform_metrics(explode_points(windows, keys))
    beats = errors.beat_errors(windows, window_seconds, list(keys))
    return waveform, errors.scalar_error_summary(beats, "error", ["metric"])


def explode_points(windows: DataFrame, keys) -> DataFrame:
    """Truth and prediction sample by sample; a plain generator, nothing is shuffled."""
    return windows.select(*keys, F.posexplode(F.arrays_zip("y_true", "y_pred")).alias("i", "__p")
                          ).select(*keys, "i", F.col("__p.y_true").alias("y_true"),
                                   F.col("__p.y_pred").alias("y_pred"))


def patient_metrics_waveform(windows: DataFrame, window_seconds: float,
                             shift_ms: float = fixed.SHIFT_MS,
                             n_bootstrap: int = fixed.BOOTSTRAP_SAMPLES,
                             seed: int = fixed.BOOTSTRAP_SEED, reference_qc: dict = None,
                             shift_samples: int = None,
                             method: str = "", metrics_json: str = "") -> dict:
    """Per-patient waveform metrics with summaries, intervals, the table row, run totals and the report of
    the check; `documents.write_metrics_document` makes one nested document of them.

    `windows`: subject_id, window_id, y_true, y_pred. `reference_qc` holds thresholds and
    switches the check of the truth on (an empty dict means the defaults).
    """
    subjects, every, report = windows.select("subject_id").distinct(), windows, None
    if reference_qc is not None:
        flagged = quality.waveform_qc(windows, **reference_qc)
        report, windows = quality.waveform_qc_report(flagged), flagged.where("qc_valid")
    # One pass over the arrays; what follows works on a few numbers per window.
    stats = materialize(errors.window_statistics(windows, ["subject_id", "window_id"], shift_ms,
                                                 window_seconds, shift_samples=shift_samples))
    truth = windows.select("subject_id", F.explode("y_true").alias("y_true"))
    ranges = exact_quantiles(truth, ["subject_id"], "y_true", {"true_p01": 0.01, "true_p99": 0.99})
    wave = patients.patient_metrics_from_statistics(stats, ranges)
    beats = errors.beat_errors_from(stats, ["subject_id", "window_id"])
    per_metric = errors.scalar_error_summary(beats, "error", ["subject_id", "metric"])
    scalar = per_metric.groupBy("subject_id").agg(*[
        F.max(F.when(F.col("metric") == m, F.col(v))).alias(f"{m}_{v}_mmHg")
        for m in fixed.SCALAR_METRICS for v in ("mae", "rmse")])
    # Patients without any usable window stay in the list with empty metrics.
    table = materialize(subjects.join(wave, "subject_id", "left")
                        .join(scalar, "subject_id", "left"))
    pooled = errors.scalar_error_summary(beats, "error", ["metric"])
    names = ["mae_mmHg", "rmse_mmHg", "min_mae_mmHg", "min_rmse_mmHg", "nrmse", "corr"]
    names += [f"{m}_{v}_mmHg" for m in fixed.SCALAR_METRICS for v in ("mae", "rmse")]
    reach = F.rint(F.lit(shift_ms / 1000.0) * F.max(F.size("y_true")) / F.lit(float(window_seconds)))
    totals = table.agg(F.count(F.lit(1)).alias("n_patients"), F.coalesce(F.sum("n_windows"), F.lit(0)).alias("n_windows"),
                       F.coalesce(F.sum("n_points"), F.lit(0)).alias("n_points"))
    whole = every.agg(F.count(F.lit(1)).alias("n_windows_original"),
                      (reach if shift_samples is None else F.lit(shift_samples)).cast("bigint").alias("max_shift_samples"))
    return {**_summaries(table, names, pooled, n_bootstrap, seed, method, metrics_json), "reference_qc": report,
            "totals": _beside(totals, whole)}


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two one-row results as one row."""
    return one.withColumn("__o", other.select(F.struct("*")).scalar()).select(*one.columns, "__o.*")


def patient_metrics_scalar(preds: DataFrame, labels: DataFrame = None,
                           n_bootstrap: int = fixed.BOOTSTRAP_SAMPLES,
                           seed: int = fixed.BOOTSTRAP_SEED, reference_qc: dict = None,
                           method: str = "", metrics_json: str = "") -> dict:
    """The same of scalar predictions; filtered patients vanish."""
    if labels is not None:
        preds = alignment.attach_subjects(preds, labels)
    every, report = preds, None
    if reference_qc is not None:
        flagged = quality.scalar_qc(preds, **reference_qc)
        report, preds = quality.scalar_qc_report(flagged), flagged.where("qc_valid")
    per_metric = stored(patients.patient_scalar_metrics(preds).select("subject_id", "metric", "mae", "rmse"), "patients")
    table = per_metric.groupBy("subject_id").agg(*[
        F.max(F.when(F.col("metric") == m, F.col(v))).alias(f"{m}_{v}_mmHg")
        for m in fixed.SCALAR_METRICS for v in ("mae", "rmse")])
    names = [f"{m}_{v}_mmHg" for m in fixed.SCALAR_METRICS for v in ("mae", "rmse")]
    pooled = patients.pooled_scalar_metrics(preds)
    number = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    totals = _beside(_beside(number(table, "n_patients"), number(preds, "n_scalar_predictions")),
                     number(every, "n_scalar_predictions_original"))
    return {**_summaries(table, names, pooled, n_bootstrap, seed, method, metrics_json), "reference_qc": report,
            "totals": totals}


def _summaries(table, names, pooled, n_bootstrap, seed, method, metrics_json):
    long = stored(patients.to_long(table, "subject_id", names), "values")
    summary = patients.distribution_summary(long, names)
    ci = patients.bootstrap_ci(long, "subject_id", n_bootstrap, seed)
    summary = materialize(summary.join(ci, "metric", "left"))
    pooled = materialize(pooled)
    row = patients.patient_table(summary, pooled, method, metrics_json,
                                 table.agg(F.count(F.lit(1)).alias("n")))
    return {"patients": table, "summary": summary, "pooled": pooled, "table": row}


def prepare_windows(samples: DataFrame, window_sec: float, step_sec: float, target_length: int,
                    keep: int = None, normalize: str = "none", cols=("ppg", "abp")) -> dict:
    """Windows ready for a model: cut, resample, normalise, number; plus the funnel.

    `normalize`: "none", "minmax" (constants from train and val, applied to all) or "slots"
    (unit-range pulse and ecg with scaled pressure in a four-slot vector). A `keep` beyond the
    target length and a split without a window to keep are errors.
    """
    if keep is not None and keep > target_length:
        raise ValueError(f"keep={keep} is more than target_length={target_length}")
    cols = list(cols)
    candidates = fixed_windows(samples, window_sec, step_sec, cols, keep_all=True)
    finite = F.col("n_bad") == 0
    made = candidates.withColumns({
        c: F.when(finite, resample_linear(c, target_length, keep)) for c in cols})
    flat = None
    if normalize == "slots":
        made = made.withColumns({"ppg": F.when(finite, unit_range("ppg")),
                                 "ecg": F.when(finite, unit_range("ecg"))})
        flat = F.col("ppg").isNull() | F.col("ecg").isNull()
    # Windows are built by a shuffle and used three times: counted, fitted, written.
    made = stored(made, "windows")
    funnel = materialize(window_funnel(made, flat, samples))
    bare = [r["split"] for r in funnel.where("kept_windows = 0").select("split").collect()]
    if bare:
        raise ValueError(f"no window to keep in split {sorted(map(str, bare))}")
    kept = made.where(finite if flat is None else finite & ~flat)
    constants = None
    if normalize == "minmax":
        constants = signals.fit_minmax(kept, cols)
        kept = signals.apply_minmax(kept, constants, cols)
    elif normalize == "slots":
        scaled = F.transform("abp", lambda v: (v - fixed.SLOT_BP_CENTER) / fixed.SLOT_BP_SCALE)
        kept = kept.withColumn("full_signal", pack_slots("ppg", scaled, "ecg"))
    indexed = assign_index(kept, ["subject_id", "record_id", "window_index"])
    return {"windows": indexed, "funnel": funnel, "constants": constants}


def embedding_probe(segments: DataFrame, labels: DataFrame, targets: list, dim: int,
                    folds: DataFrame, test: DataFrame) -> dict:
    """Ridge probe on pooled embeddings: penalty by folds, fit, predict, summarise.

    `folds` gives the fold of every fitted case; `test` holds the cases to predict.
    """
    pooled = linear.pool_embeddings(segments, dim=dim)
    table = materialize(alignment.align_targets(pooled, labels))
    fit = table.join(folds, "case_key")
    models, scores = linear.fit_ridge_cv(fit, targets, "fold", dim)
    preds = table.join(test.select("case_key"), "case_key", "left_semi")
    for t in targets:
        preds = linear.predict_ridge(preds, models[t], f"{t}_pred")
    long = preds.select("case_key", F.explode(F.array(*[F.struct(
        F.lit(t).alias("metric"), (F.col(f"{t}_pred") - F.col(t)).alias("error"))
        for t in targets])).alias("__e")).select("case_key", "__e.*")
    return {"predictions": preds.drop("embedding"), "models": models, "scores": scores,
            "summary": errors.scalar_error_summary(long, "error", ["metric"])}
