"""Error metrics, patients, runs and models."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.operators import (alignment as G, errors as E, linear as L, patients as P,
                                 quality as Q, runs as R, splits as D)
from pulsemill.plans import jobs


def shifted(t, p, k):
    mae = rmse = np.inf
    k = min(k, max(0, len(t) - 1))
    for s in range(-k, k + 1):
        d = [p[i + s] - t[i] for i in range(len(t))
             if 0 <= i + s < len(p) and t[i] is not None and p[i + s] is not None]
        if d:
            mae, rmse = min(mae, np.mean(np.abs(d))), min(rmse, np.sqrt(np.mean(np.square(d))))
    return (mae, rmse) if np.isfinite(mae) else (None, None)


def test_min_shift_errors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):
        n = int(rng.integers(1, 30))
        gap = lambda: [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=n)]
        rows.append((k, gap(), gap()))
    rows += [(90, [None], [1.0]), (91, [1.0, 2.0], [None, None])]
    df = spark.createDataFrame(rows, "k int, y_true array<double>, y_pred array<double>")
    got = {r.k: (r.min_mae, r.min_rmse)
           for r in E.min_shift_errors(df, 0, 1, shift_samples=4).collect()}
    for k, t, p in rows:
        want = shifted(t, p, 4)
        if want[0] is None:
            assert got[k] == (None, None)
        else:
            np.testing.assert_allclose(got[k], want)


def test_flat_side_gives_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0), (float("nan"), 1.0)],
                               "y_true double, y_pred double")
    r = E.waveform_metrics(df).first()
    assert (r.n_points, r.waveform_mae, r.waveform_corr) == (2, 1.5, None)


def test_empty_errors(spark):
    df = spark.createDataFrame([(None,), (float("inf"),)], "error double")
    r = E.scalar_error_summary(df).first()
    assert r.n_beats == 0 and r.mae is None and r.bhs_grade is None and r.aami_compliant is None


@pytest.mark.parametrize("errors,grade", [([1.0] * 20, "A"), ([4.0] * 11 + [9.0] * 5 + [12.0] * 4, "B"),
                                          ([4.0] * 9 + [9.0] * 5 + [12.0] * 6, "C"), ([20.0] * 5, "D")])
def test_grades(spark, errors, grade):
    df = spark.createDataFrame([(e,) for e in errors], "error double")
    assert E.scalar_error_summary(df).first().bhs_grade == grade


def test_beats_pair_by_position_after_drops(spark):
    x = [0.0, 1.0, 5.0, 1.0, 0.0, 1.0, 7.0, 1.0, 0.0, 1.0, 6.0, 1.0, 0.0]
    p = list(x)
    p[1] = None
    df = spark.createDataFrame([(1, x, p)], "w int, y_true array<double>, y_pred array<double>")
    got = [(r.beat, r.error) for r in E.beat_errors(df, 13.0, ["w"]).where("metric = 'sbp'")
           .orderBy("beat").collect()]
    assert got == [(0, 2.0), (1, -1.0)]


def test_bootstrap_matches_plain_resampling(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(100, 10, 23)
    numbered = values[sorted(range(23), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())]
    df = spark.createDataFrame([(k, "m", float(v)) for k, v in enumerate(values)]
                               + [(0, "one", 7.0)], "s int, metric string, value double")
    got = {r.metric: (r.ci_low, r.ci_high) for r in P.bootstrap_ci(df, "s", 400, 11).collect()}
    means, every = [], []
    m = P.DRAW_PRIME
    for b in range(400):
        u = pow((b * 48271 + 11) % m, 5, m)
        x = [pow((u + j * 69621) % m, 5, m) for j in range(23)]
        picks = [(v * m + pow((v + u * 40692) % m, 5, m)) % 23 for v in x]
        means.append(numbered[picks].mean())
        every += picks
    # Picks are even, and means spread as those of independent picks do.
    assert np.abs(np.bincount(every, minlength=23) - 400).max() < 100
    assert np.std(means) == pytest.approx(values.std() / np.sqrt(23), rel=0.12)
    np.testing.assert_allclose(got["m"], np.percentile(means, [2.5, 97.5]))
    assert got["one"] == (7.0, 7.0)
    rough = np.percentile([values[rng.integers(0, 23, 23)].mean() for _ in range(4000)], [2.5, 97.5])
    np.testing.assert_allclose(got["m"], rough, atol=1.0)
    none = {r.metric: r.ci_low for r in P.bootstrap_ci(df, "s", 0, 11).collect()}
    assert none["m"] == pytest.approx(values.mean())


def ridge_svd(x, y, alpha):
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1.0
    u, s, vt = np.linalg.svd((x - mean) / sd, full_matrices=False)
    return vt.T @ (s / (s * s + alpha) * (u.T @ (y - y.mean()))), y.mean(), mean, sd


def test_ridge_and_penalty_choice(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 6)) + 3.0
    x[:, 5] = 2.0
    y = x[:, 0] * 4 - x[:, 1] + rng.normal(size=50)
    fold = np.repeat(range(4), [13, 13, 12, 12])
    df = spark.createDataFrame([([float(v) for v in a], float(b), int(f)) for a, b, f in zip(x, y, fold)],
                               "embedding array<double>, t double, fold int")
    models, scores = L.fit_ridge_cv(df, ["t"], "fold", 6)
    want = {}
    for alpha in (0.1, 1.0, 10.0, 100.0, 1000.0):
        e = []
        for f in range(4):
            c, b, m, s = ridge_svd(x[fold != f], y[fold != f], alpha)
            e.append(np.mean(((x[fold == f] - m) / s @ c + b - y[fold == f]) ** 2))
        want[alpha] = np.mean(e)
    np.testing.assert_allclose([s[2] for s in scores], list(want.values()), rtol=1e-8)
    best = min(want, key=want.get)
    assert models["t"].alpha == best
    c, b, m, s = ridge_svd(x, y, best)
    np.testing.assert_allclose(models["t"].coef, c, atol=1e-9)
    pred = np.array([r.p for r in L.predict_ridge(df, models["t"], "p").collect()])
    np.testing.assert_allclose(np.sort(pred), np.sort((x - m) / s @ c + b), atol=1e-9)
    one = L.fit_ridge(df, "t", 10.0, 6)
    np.testing.assert_allclose(one.coef, ridge_svd(x, y, 10.0)[0], atol=1e-9)


def test_group_split_keeps_groups_together(spark):
    df = spark.createDataFrame([(k % 10, k) for k in range(100)] + [(None, 200)], "g int, k int")
    out = D.group_split(df, "g", 0.25).collect()
    sides = {}
    for r in out:
        sides.setdefault(r.g, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values()) and sides[None] == {"train"}
    assert sum(s == {"val"} for s in sides.values()) == 2  # round(2.5) is 2
    assert len(out) == 101
    with pytest.raises(ValueError):
        D.group_split(df.where("g = 1"), "g")


def test_folds_need_enough_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    sizes = {r.fold: r.n for r in D.kfold(df, 4, ["k"], [F.floor(F.col("k") / 3)]).groupBy("fold")
             .agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 3, 1: 3, 2: 2, 3: 2}
    with pytest.raises(ValueError):
        D.kfold(df, 11, ["k"], [F.lit(0)])


def test_nan_is_not_above_the_limit(spark):
    df = spark.createDataFrame([(1, [100.0, float("nan")]), (1, [60.0, 120.0]), (1, [90.0, 90.0])],
                               "subject_id int, y_true array<double>")
    r = Q.waveform_qc_report(Q.waveform_qc(df)).first()
    assert (r.n_windows_valid, r.nonfinite, r.above_max_abp, r.below_min_std, r.below_min_range) == (1, 1, 0, 1, 1)
    with pytest.raises(ValueError):
        Q.waveform_qc(df, min_range=50.0, max_range=10.0)


def test_patients_without_valid_windows_stay_listed(spark):
    good = [float(80 + 30 * np.sin(k)) for k in range(16)]
    df = spark.createDataFrame([("a", 1, good, good), ("b", 2, [90.0] * 16, good)],
                               "subject_id string, window_id int, y_true array<double>, y_pred array<double>")
    out = jobs.patient_metrics_waveform(df, 4.0, n_bootstrap=5, reference_qc={}, method="m")
    rows = {r.subject_id: r for r in out["patients"].collect()}
    assert rows["a"].mae_mmHg == 0.0 and rows["b"].mae_mmHg is None
    summary = {r.metric: r for r in out["summary"].collect()}
    assert summary["mae_mmHg"].n_patients == 1
    assert out["table"].first()["MAE [95% CI]"] == "0.00 [0.00, 0.00]"
    assert out["table"].first()["n_patients"] == 1


def test_table_count_falls_through_zero(spark):
    summary = spark.createDataFrame([("mae_mmHg", 0, None, None, None), ("sbp_mae_mmHg", 3, 1.0, 1.0, 1.0)],
                                    "metric string, n_patients bigint, mean double, ci_low double, ci_high double")
    pooled = spark.createDataFrame([("sbp", 1.0, 2.0)], "metric string, bias double, std double")
    row = P.patient_table(summary, pooled, "m", "x").first()
    assert row.n_patients == 3 and row["MAE"] is None and row["SBP ME +/- error SD"] == "1.00 +/- 2.00"


def test_seed_deviation_is_a_sample_deviation(spark):
    df = spark.createDataFrame([("0", "m", "MAE", "p", 2, 1.0), ("1", "m", "MAE", "p", 2, 3.0),
                                ("0", "m", "RMSE", "q", 2, 5.0), ("1", "m", "RMSE", "q", 2, None)],
                               "seed_label string, method string, metric string, metric_path string, digits int, value double")
    got = {r.metric: r for r in P.aggregate_seeds(df).collect()}
    assert got["MAE"].seed_sd == pytest.approx(2 ** 0.5) and got["RMSE"].seed_sd is None
    assert got["RMSE"].estimate_text == "" and got["MAE"].estimate_text == "2.00 +/- 1.41"
    with pytest.raises(ValueError):
        P.aggregate_seeds(df.withColumn("method", F.col("seed_label")))


def test_decay_time(spark):
    t = np.arange(6) * 0.25
    rows = [(1, i, 0.25, 35.0 + 40 * float(np.exp(-v / 1.7)), 35.0) for i, v in enumerate(t)]
    rows += [(2, i, 0.25, 36.0 + i, 35.0) for i in range(4)] + [(3, 0, 0.25, 50.0, 35.0)]
    rows += [(4, i, 0.25, 35.0 - (i == 2), 35.0) for i in range(5)]
    df = spark.createDataFrame(rows, "segment_id int, i int, dt double, p double, p_inf double")
    got = {r.segment_id: r.log_tau for r in R.decay_tau(df).collect()}
    assert got[1] == pytest.approx(np.log(1.7)) and got[2] is got[3] is got[4] is None


def test_best_epoch_takes_the_earliest(spark):
    df = spark.createDataFrame([(1, 2.0, 0.5), (2, 1.0, 0.9), (3, 1.0, 0.9), (4, None, float("nan"))],
                               "epoch int, val_mae double, val_corr double")
    assert R.best_epoch(df, "val_mae").first().best_epoch == 2
    assert R.best_epoch(df, "val_corr").first().best_epoch == 2


def test_small_windows_are_left_out(spark):
    df = spark.createDataFrame([(1, float(i), float(i)) for i in range(5)]
                               + [(2, float(i), float(i + 1)) for i in range(6)],
                               "window_id int, y_true double, y_pred double")
    r = R.validation_metrics(df).first()
    assert (r.n_windows, r.n_points, r.val_mae, r.val_loss) == (1, 6, 1.0, 1.0)


def test_target_length_must_agree(spark):
    w = spark.createDataFrame([("k", [True] * 8)], "window_key string, mask array<boolean>")
    s = lambda t: spark.createDataFrame([("k", 2, 5, t)], "window_key string, dia_start int, dia_end int, target_T int")
    assert G.join_tau_segments(w, s(8)).count() == 1
    with pytest.raises(Exception, match="target_T"):
        G.join_tau_segments(w, s(9)).collect()


def test_prediction_counts_must_agree(spark):
    meta = spark.createDataFrame([("test", 0), ("test", 1), ("train", 0)], "split string, memmap_index int")
    preds = spark.createDataFrame([(0, 1.0)], "memmap_index int, p double")
    with pytest.raises(ValueError):
        G.attach_metadata(preds, meta)


def test_bootstrap_counts_draws_in_tiles_and_spans(spark):
    # Three metrics, two numbers of patients; tiles and spans smaller than either.
    rng = np.random.default_rng(8)
    rows = [(k, m, float(rng.normal(50, 9))) for m, n in (("a", 41), ("b", 41), ("c", 30)) for k in range(n)]
    df = spark.createDataFrame(rows, "s int, metric string, value double")
    whole = {r.metric: (r.ci_low, r.ci_high) for r in P.bootstrap_ci(df, "s", 150, 3).collect()}
    cut = {r.metric: (r.ci_low, r.ci_high) for r in P.bootstrap_ci(df, "s", 150, 3, tile=7, span=14).collect()}
    assert set(cut) == {"a", "b", "c"}
    m = P.DRAW_PRIME
    for name, ends in cut.items():
        own = {k: v for k, metric, v in rows if metric == name}
        numbered = np.array([own[k] for k in sorted(own, key=lambda k: hashlib.md5(str(k).encode()).hexdigest())])
        means = []
        for b in range(150):
            u = pow((b * 48271 + 3) % m, 5, m)
            x = [pow((u + j * 69621) % m, 5, m) for j in range(len(own))]
            means.append(numbered[[(v * m + pow((v + u * 40692) % m, 5, m)) % len(own) for v in x]].mean())
        np.testing.assert_allclose(ends, np.percentile(means, [2.5, 97.5]))
        np.testing.assert_allclose(ends, whole[name])
