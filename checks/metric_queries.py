"""Alignment, error metrics, patient metrics, run history, linear models."""

import pandas as pd
from pyspark.sql import functions as F

from checks import views as V
from checks.manifest_queries import err_sql, summary_sql
from checks.registry import query, r, rs, tidy, with_
from checks.signal_queries import EXTRACT, PAIRS, SEGS, BEAT_CUTS, STATS, TRANSIT, WINDOW_PEAKS
from pulsemill.functions import fixed
from pulsemill.functions.text import format_mean_sd
from pulsemill.operators import (alignment as G, errors as E, linear as L, patients as P,
                                 runs as R, splits as D, transit as X)
from pulsemill.plans.jobs import explode_points
from pulsemill.sources import results
from pulsemill.sources.storage import scratch_path



def wave_sql(src, by=()):
    keys = "".join(f"{b}, " for b in by)
    group = f" group by {', '.join(by)}" if by else ""
    return f"""
select {keys}count(e) as n_points, {r('avg(abs(e))', 'waveform_mae')}, {r('sqrt(avg(e * e))', 'waveform_rmse')},
 {r('case when var_pop(x) <= 1e-12 or var_pop(y) <= 1e-12 then null else covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end', 'waveform_corr')}
from (select *, case when ok then y_true end as x, case when ok then y_pred end as y, case when ok then y_pred - y_true end as e
 from (select *, y_true is not null and y_pred is not null as ok from {src})){group}"""


# ---------------------------------------------------------------- alignment

LABELS = ("labels_v", """
select case_key, max(subject_id) as subject_id from (select l_orderkey as case_key, l_suppkey as subject_id from lineitem where l_orderkey % 5 <> 0) group by case_key""")


def case_labels(spark, d):
    p = V.scalar_preds(spark, d)
    return p.where(F.col("case_key") % 5 != 0).groupBy("case_key").agg(
        F.max("subject_id").alias("subject_id"))


@query("g1_attach_subjects", with_("scalar_preds", LABELS) + f"""
select p.case_key, coalesce(cast(l.subject_id as varchar), cast(p.case_key as varchar)) as subject_id, {rs('sbp_true', 'sbp_pred')}
from scalar_preds p left join labels_v l on l.case_key = p.case_key""")
def g1(spark, d):
    p = V.scalar_preds(spark, d).drop("subject_id")
    return tidy(G.attach_subjects(p, case_labels(spark, d)).select(
        "case_key", "subject_id", "sbp_true", "sbp_pred"))


@query("g2_attach_metadata", with_("points", ("w", "select distinct window_id, subject_id from points where window_id % 3 = 0")) + """
select window_id, 'test' as split, 'r' || subject_id as record_id, count(y_true) as n_true from points join w using (window_id) group by window_id, w.subject_id, record_id""".replace("group by window_id, w.subject_id, record_id", "group by window_id, 'r' || subject_id").replace("'r' || subject_id as record_id", "'r' || w.subject_id as record_id").replace("group by window_id, 'r' || subject_id", "group by window_id, w.subject_id"))
def g2(spark, d):
    w = V.windows(spark, d).where(F.col("window_id") % 3 == 0)
    meta = V.windows(spark, d).select(
        "window_id", F.when(F.col("window_id") % 3 == 0, "test").otherwise("train").alias("split"),
        F.concat(F.lit("r"), F.col("subject_id").cast("string")).alias("record_id"))
    preds = w.select("window_id", F.size(F.filter("y_true", lambda v: v.isNotNull())).cast("bigint").alias("n_true"))
    return G.attach_metadata(preds, meta, "window_id")


@query("g3_join_tau_segments", with_("points", ("w", "select window_id, count(*) as n from points group by window_id"), ("s", """
select window_id, k, 3 * k as dia_start, 3 * k + 4 as dia_end from (select window_id, n, unnest(range(1, (n - 4) // 3 + 1)) as k from w where n >= 7)""")) + """
select s.window_id, cast(dia_start as int) as dia_start, cast(dia_end as int) as dia_end from s join points p on p.window_id = s.window_id and p.i >= dia_start and p.i < dia_end
group by s.window_id, dia_start, dia_end having count(y_true) = count(*)""")
def g3(spark, d):
    w = V.windows(spark, d).select(
        "window_id", F.col("window_id").cast("string").alias("window_key"),
        F.transform("y_true", lambda v: v.isNotNull()).alias("mask"))
    s = w.where(F.size("mask") >= 7).select(
        "window_key", F.size("mask").alias("target_T"), F.explode(F.expr("sequence(1, (size(mask) - 4) div 3)")).alias("k"))
    s = s.select("window_key", "target_T", (F.col("k") * 3).alias("dia_start"), (F.col("k") * 3 + 4).alias("dia_end"))
    return G.join_tau_segments(w, s).select("window_id", "dia_start", "dia_end")


@query("g4_align_targets", with_("case_embeddings") + f"""
select case_key, {rs('target')}, {r('list_sum(embedding::double[])', 'total')} from case_embeddings where case_key % 3 <> 0""")
def g4(spark, d):
    c = V.case_embeddings(spark, d)
    labels = c.where(F.col("case_key") % 3 != 0).select("case_key", "target")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return tidy(G.align_targets(c.select("case_key", "embedding"), labels).select(
        "case_key", "target", total.alias("total")))


# ---------------------------------------------------------------- error metrics

@query("a1_waveform_metrics", with_("points") + wave_sql("points", ["subject_id"]))
def a1(spark, d):
    return tidy(E.waveform_metrics(V.points(spark, d), ["subject_id"]))


@query("a1_waveform_metrics_pooled", with_("points") + wave_sql("points"))
def a1b(spark, d):
    return tidy(E.waveform_metrics(V.points(spark, d)))


@query("a2_scalar_error_summary", with_("scalar_preds", err_sql("scalar_preds")) + summary_sql("err", ["metric"]))
def a2(spark, d):
    return tidy(E.scalar_error_summary(E.scalar_errors_long(V.scalar_preds(spark, d)), "error", ["metric"]))


# Beats of each side numbered among its own kept beats, then paired by number.
BEAT_ERR = [*WINDOW_PEAKS, BEAT_CUTS, SEGS, STATS,
            ("tb", "select *, row_number() over (partition by window_id order by beat_start) as k from bstats where t_ok"),
            ("pb", "select *, row_number() over (partition by window_id order by beat_start) as k from bstats where p_ok"),
            ("be", "select t.window_id, t.k - 1 as beat, p.p_sbp - t.t_sbp as sbp, p.p_dbp - t.t_dbp as dbp, p.p_map - t.t_map as mp from tb t join pb p using (window_id, k)"),
            ("err", """
select window_id, beat, 'sbp' as metric, sbp as e from be union all select window_id, beat, 'dbp', dbp from be union all select window_id, beat, 'map', mp from be""")]


@query("a3_beat_errors", with_("points", *BEAT_ERR) + f"select window_id, cast(beat as int) as beat, metric, {r('e', 'error')} from err")
def a3(spark, d):
    return tidy(E.beat_errors(V.windows(spark, d), 4.0, ["window_id"]))


SHIFT_SQL = [("kk", "select window_id, least(cast(round_even(0.25 * count(*) / 4.0, 0) as bigint), count(*) - 1) as k from points group by window_id"),
             ("sh", """
select window_id, s, avg(abs(d)) as mae, sqrt(avg(d * d)) as rmse from (
 select a.window_id, s.s, b.y_pred - a.y_true as d from (select window_id, unnest(range(-k, k + 1)) as s from kk) s
 join points a on a.window_id = s.window_id join points b on b.window_id = a.window_id and b.i = a.i + s.s) where d is not null group by window_id, s"""),
             ("shift", "select window_id, min(mae) as min_mae, min(rmse) as min_rmse from sh group by window_id")]


@query("a4_min_shift_errors", with_("points", *SHIFT_SQL) + f"select window_id, {r('min_mae * 0.1333223684', 'min_mae_kpa')}, {r('min_rmse')} from shift")
def a4(spark, d):
    w = E.min_shift_errors(V.windows(spark, d), 250.0, 4.0)
    return tidy(w.where("min_mae is not null").select(
        "window_id", (F.col("min_mae") * 0.1333223684).alias("min_mae_kpa"), "min_rmse"))


PATIENT_SQL = [*SHIFT_SQL,
               ("wv", wave_sql("points", ["subject_id"])),
               ("rng", """
select subject_id, quantile_cont(y_true, 0.01) as p01, quantile_cont(y_true, 0.99) as p99, count(distinct window_id) as nw from points group by subject_id"""),
               ("sm", "select subject_id, avg(min_mae) as min_mae, avg(min_rmse) as min_rmse from shift join (select distinct window_id, subject_id from points) using (window_id) group by subject_id"),
               ("patient", f"""
select subject_id, nw as n_windows, n_points, waveform_mae as mae, waveform_rmse as rmse, waveform_corr as corr, min_mae, min_rmse,
 waveform_rmse / (p99 - p01) as nrmse, p01, p99 from wv join rng using (subject_id) join sm using (subject_id)""")]


@query("a5_patient_waveform_metrics", with_("points", *PATIENT_SQL) + f"""
select subject_id, n_windows, n_points, {r('mae', '"mae_mmHg"')}, {r('rmse', '"rmse_mmHg"')}, {r('corr')}, {r('min_mae * 0.1333223684', 'min_mae_kpa')},
 {r('min_rmse', '"min_rmse_mmHg"')}, round(nrmse, 6) + 0.0 as nrmse, {r('p01', 'true_p01')}, {r('p99', 'true_p99')} from patient""")
def a5(spark, d):
    w = E.min_shift_errors(V.windows(spark, d), 250.0, 4.0)
    # Means of few decimal numbers can end exactly on a rounding edge; other units do not.
    return tidy(P.patient_waveform_metrics(V.points(spark, d), w).withColumns(
        {"nrmse": F.round("nrmse", 6), "min_mae_kpa": F.col("min_mae_mmHg") * 0.1333223684})
        .drop("min_mae_mmHg"))


@query("a6_patient_scalar_metrics", with_("scalar_preds", err_sql("scalar_preds", "subject_id, ")) + summary_sql("err", ["subject_id", "metric"]))
def a6(spark, d):
    return tidy(P.patient_scalar_metrics(V.scalar_preds(spark, d)))


PATIENT_LONG = [("scalar_p", """
select subject_id, metric, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse from err group by subject_id, metric"""),
                ("plong", """
select subject_id, metric || '_mae_mmHg' as metric, mae as value from scalar_p union all select subject_id, metric || '_rmse_mmHg', rmse from scalar_p""")]
DIST = ("dist", "select metric, count(*) as n_patients, avg(value) as mean, quantile_cont(value, 0.25) as iqr_low, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as iqr_high from plong group by metric")


def patient_long(spark, d):
    p = P.patient_scalar_metrics(V.scalar_preds(spark, d))
    wide = p.groupBy("subject_id").agg(*[
        F.max(F.when(F.col("metric") == m, F.col(v))).alias(f"{m}_{v}_mmHg")
        for m in fixed.SCALAR_METRICS for v in ("mae", "rmse")])
    return P.to_long(wide, "subject_id", [c for c in wide.columns if c != "subject_id"])


@query("a7_distribution_summary", with_("scalar_preds", err_sql("scalar_preds", "subject_id, "), *PATIENT_LONG, DIST) + f"""
select metric, n_patients, {rs('mean', 'iqr_low', 'median', 'iqr_high')} from dist""")
def a7(spark, d):
    return tidy(P.distribution_summary(patient_long(spark, d)))


def fifth_sql(x):
    m = P.DRAW_PRIME
    return f"(({x} * {x} % {m}) * ({x} * {x} % {m}) % {m}) * {x} % {m}"


def boot_sql(src, b, seed=2025):
    return [("ranked", f"select metric, value, row_number() over (partition by metric order by md5(cast(subject_id as varchar))) - 1 as j, count(*) over (partition by metric) as n from {src}"),
            ("reps", f"select b, {fifth_sql('u')} as u from (select b, (b * 48271 + {seed % P.DRAW_PRIME}) % {P.DRAW_PRIME} as u from (select unnest(range({b})) as b))"),
            ("draws", f"""
select n, b, (x * {P.DRAW_PRIME} + {fifth_sql('y')}) % n as pick from (
 select *, (x + u * 40692 + j // {P.DRAW_PRIME}) % {P.DRAW_PRIME} as y from (
  select n, b, j, u, {fifth_sql('x')} as x from (
   select n, b, j, u, (u + j % {P.DRAW_PRIME} * 69621) % {P.DRAW_PRIME} as x from (select distinct n, j from ranked), reps)))"""),
            ("means", "select r.metric, d.b, avg(r.value) as m from draws d join ranked r on r.n = d.n and r.j = d.pick group by r.metric, d.b"),
            ("ci", "select metric, quantile_cont(m, 0.025) as ci_low, quantile_cont(m, 0.975) as ci_high from means group by metric")]


@query("a8_bootstrap_ci", with_("scalar_preds", err_sql("scalar_preds", "subject_id, "), *PATIENT_LONG, *boot_sql("plong", 2000)) + f"""
select metric, {rs('ci_low', 'ci_high')} from ci""")
def a8(spark, d):
    return tidy(P.bootstrap_ci(patient_long(spark, d), "subject_id", 2000, 2025))


TABLE_NUMBERS = ", ".join(f"max(case when metric = '{m}_mae_mmHg' then round({c}, 8) + 0.0 end) as {m}_{n}"
                          for m in ("sbp", "dbp", "map") for c, n in (("mean", "mean"), ("ci_low", "low"), ("ci_high", "high")))


@query("a9_patient_table", with_("scalar_preds", err_sql("scalar_preds", "subject_id, "), *PATIENT_LONG, DIST, *boot_sql("plong", 2000),
       ("both_t", "select * from dist join ci using (metric)"), ("one", f"select {TABLE_NUMBERS}, max(n_patients) as n_patients from both_t"),
       ("pool", f"select {r('avg(e)', 'bias')}, {r('stddev_pop(e)', 'sd')} from err where metric = 'dbp'")) + """
select 'demo' as method, one.*, pool.bias as dbp_me, pool.sd as dbp_sd, cast(null as double) as mae, '' as mae_text,
 printf('%.2f', dbp_mean) || ' [' || printf('%.2f', dbp_low) || ', ' || printf('%.2f', dbp_high) || ']' as dbp_text from one, pool""")
def a9(spark, d):
    long = patient_long(spark, d)
    summary = P.distribution_summary(long).join(
        P.bootstrap_ci(long, "subject_id", 2000, 2025), "metric")
    row = P.patient_table(summary, P.pooled_scalar_metrics(V.scalar_preds(spark, d)), "demo", "m.json")
    c = lambda n: F.col(f"`{n}`")
    cols = [c(f"{m.upper()} err{s}").alias(f"{m}_{n}") for m in fixed.SCALAR_METRICS
            for s, n in (("", "mean"), (" ci_low", "low"), (" ci_high", "high"))]
    return tidy(row.select("method", *cols, "n_patients", c("DBP ME").alias("dbp_me"),
                           c("DBP error SD").alias("dbp_sd"), c("MAE").alias("mae"),
                           c("MAE [95% CI]").alias("mae_text"), c("DBP err [95% CI]").alias("dbp_text")))


SEED_ROWS = ("seeds", """
select cast(k as varchar) as seed_label, avg(e) as bias, stddev_pop(e) as sd, avg(abs(e)) as mae from (
 select case_key % 3 as k, dbp_pred - dbp_true as e from scalar_preds) group by k""")


@query("a10_aggregate_seeds", with_("scalar_preds", SEED_ROWS, ("v", """
select 'DBP err' as metric, seed_label, round(mae, 8) as value from seeds union all select 'DBP ME', seed_label, round(bias, 8) from seeds
 union all select 'DBP error SD', seed_label, case when seed_label = '0' then null else round(sd, 8) end from seeds""")) + f"""
select 'demo' as method, metric, count(value) as n_seeds, {r('avg(value)', 'estimate_mean')}, {r('stddev_samp(value)', 'seed_sd')},
 {r('min(value)', 'lowest')}, {r('max(value)', 'highest')}, count(*) as n_listed from v group by metric""")
def a10(spark, d):
    p = V.scalar_preds(spark, d).withColumn("seed", (F.col("case_key") % 3).cast("string"))
    s = E.scalar_error_summary(p.select("seed", (F.col("dbp_pred") - F.col("dbp_true")).alias("error")),
                               "error", ["seed"])
    docs = s.select("seed", F.to_json(F.struct(
        F.lit("demo").alias("method"),
        F.struct(F.struct(F.struct(F.round("mae", 8).alias("mean")).alias("dbp_mae_mmHg")).alias("scalar")).alias("patient_summary"),
        F.struct(F.struct(F.round("bias", 8).alias("bias"), F.when(F.col("seed") == "0", F.lit("nan"))
                          .otherwise(F.round("std", 8).cast("string")).alias("std")).alias("dbp")).alias("pooled_scalar"),
    )).alias("value"))
    path = scratch_path(spark, "seeds")
    docs.repartition(3, "seed").write.partitionBy("seed").text(path)
    runs = results.read_seed_runs(spark, {k: f"{path}/seed={k}" for k in ("0", "1", "2")})
    out = P.aggregate_seeds(runs).where("n_seeds > 0")
    listed = F.size(F.split("seed_values_json", "seed_label")) - 1
    return tidy(out.select("method", "metric", "n_seeds", "estimate_mean", "seed_sd",
                           F.col("min").alias("lowest"), F.col("max").alias("highest"),
                           listed.cast("bigint").alias("n_listed")))


@query("a11_compact_table", with_("points", "scalar_preds", ("w", wave_sql("points")), err_sql("scalar_preds")) + f"""
select 'demo' as method, (select waveform_mae from w) as mae, (select waveform_rmse from w) as rmse, '' as corr,
 {r("avg(case when metric = 'sbp' then abs(e) end)", 'sbp_err')} from err""")
def a11(spark, d):
    wave = tidy(E.waveform_metrics(V.points(spark, d)))
    s = tidy(P.pooled_scalar_metrics(V.scalar_preds(spark, d)))
    one = lambda m: s.where(F.col("metric") == m).select("mae").scalar()
    m = wave.select(
        F.lit("demo").alias("method"), F.col("waveform_mae").alias("MAE"), F.col("waveform_rmse").alias("RMSE"),
        F.lit(float("nan")).alias("Corr"), one("sbp").alias("SBP err"), one("dbp").alias("DBP err"),
        one("map").alias("MAP err"), F.lit("m.json").alias("metrics_json"))
    t = results.compact_table(m)
    return t.select("method", F.col("MAE").cast("double").alias("mae"), F.col("RMSE").cast("double").alias("rmse"),
                    F.col("Corr").alias("corr"), F.col("`SBP err`").cast("double").alias("sbp_err"))


# ---------------------------------------------------------------- runs

@query("a12_validation_metrics", with_("points", ("ok", "select subject_id, window_id, y_true as x, y_pred as y, y_pred - y_true as e from points where y_true is not null and y_pred is not null"),
       ("per", """
select window_id % 5 as epoch, window_id, count(*) as n, sum(abs(e)) as ae, sum(e * e) as se,
 greatest(-1.0, least(1.0, covar_pop(x, y) * count(*) / sqrt(var_pop(x) * count(*) * var_pop(y) * count(*) + 1e-12))) as corr from ok group by window_id having count(*) >= 6""")) + f"""
select epoch, count(*) as n_windows, cast(sum(n) as bigint) as n_points, {r('sum(ae) / sum(n)', 'val_mae')}, {r('sqrt(sum(se) / sum(n))', 'val_rmse')},
 {r('avg(corr)', 'val_corr')}, {r('avg(se / n)', 'val_loss')} from per group by epoch""")
def a12(spark, d):
    p = V.points(spark, d).withColumn("epoch", F.col("window_id") % 5)
    return tidy(R.validation_metrics(p, ["epoch"]))


@query("a13_masked_label_mae", with_("scalar_preds", ("v", """
select *, case_key % 4 <> 0 as cuff, case_key % 6 <> 0 as cvp, case when case_key % 9 = 0 then null else ln(sbp_true / 100) end as obs from scalar_preds""")) + f"""
select {r('avg(case when cuff then abs(sbp_pred - sbp_true) end)', 'sbp_mae')}, count(case when cuff then 1 end) as sbp_n,
 {r('avg(case when cvp then abs(dbp_pred - dbp_true) end)', 'cvp_mae')}, count(case when cvp then 1 end) as cvp_n,
 {r('avg(case when cuff and obs is not null then abs(ln(greatest(sbp_pred / 100, 1e-4)) - obs) end)', 'tau_log_mae')},
 {r('avg(case when cuff and obs is not null then abs(greatest(sbp_pred / 100, 1e-4) - exp(obs)) end)', 'tau_mae')}, count(case when cuff and obs is not null then 1 end) as tau_n from v""")
def a13(spark, d):
    k = F.col("case_key")
    p = V.scalar_preds(spark, d).withColumns({
        "cuff": k % 4 != 0, "cvp": k % 6 != 0, "tau_pred": F.col("sbp_pred") / 100,
        "obs": F.when(k % 9 != 0, F.ln(F.col("sbp_true") / 100))})
    a = R.masked_label_mae(p, {"sbp": ("sbp_true", "sbp_pred", F.col("cuff")),
                               "cvp": ("dbp_true", "dbp_pred", F.col("cvp"))})
    b = R.masked_tau_mae(p, "obs", "tau_pred", F.col("cuff"))
    names = b.columns
    out = a.withColumn("__b", b.select(F.struct(*names)).scalar())
    return tidy(out.select(*a.columns, *[F.col(f"__b.{n}").alias(n) for n in names]))


TAU_ROWS = ("tr", """
select case_key as window_id, ln(dbp_true / 50) as obs_log, ln(dbp_pred / 50) as pred_log, case when case_key % 8 = 0 then 0.0 else (case_key % 8) / 10.0 end as se,
 1.0 + case_key % 3 as weight, case_key % 5 <> 0 and case_key % 8 <> 0 as ok from scalar_preds""")


def tau_rows(spark, d):
    k = F.col("case_key")
    return V.scalar_preds(spark, d).select(
        k.alias("window_id"), F.ln(F.col("dbp_true") / 50).alias("obs_log"),
        F.ln(F.col("dbp_pred") / 50).alias("pred_log"), ((k % 8) / 10.0).alias("se"),
        (F.lit(1.0) + k % 3).alias("weight"), (k % 5 != 0).alias("valid"))


@query("a14_tau_loss", with_("scalar_preds", TAU_ROWS) + f"""
select {r('sum(case when ok then weight / (se * se) * (pred_log - obs_log) * (pred_log - obs_log) end) / sum(case when ok then weight / (se * se) end)', 'tau_loss')},
 count(case when ok then 1 end) as tau_n, {r('avg(case when ok then exp(obs_log) end)', 'tau_obs_mean')}, {r('avg(case when ok then exp(pred_log) end)', 'tau_pred_mean')} from tr""")
def a14(spark, d):
    return tidy(R.tau_loss(tau_rows(spark, d), F.col("valid")))


@query("a14_tau_shape_loss", with_("scalar_preds", TAU_ROWS, ("per", """
select window_id, avg(case when abs(pred_log - obs_log) < 0.1 then 0.5 * (pred_log - obs_log) * (pred_log - obs_log) / 0.1 else abs(pred_log - obs_log) - 0.05 end) as l,
 avg(weight / (se * se)) as w, avg(exp(pred_log)) as t, count(*) as n from tr where ok group by window_id""")) + f"""
select {r('sum(w * l) / sum(w)', 'shape_loss')}, count(*) as n_windows, cast(sum(n) as bigint) as n_segments, {r('avg(t)', 'tau_mean')} from per""")
def a14b(spark, d):
    return tidy(R.tau_shape_loss(tau_rows(spark, d), F.col("valid"), 0.1, pred="pred_log"))


HISTORY = ("hist", """
select epoch, count(*) as n_batches, avg(loss) as loss, avg(val_loss) as val_loss, cast(sum(n_labels) as bigint) as n_labels,
 sum(label_mean * n_labels) / sum(n_labels) as label_mean from epochs group by epoch""")


def history(spark, d):
    return R.epoch_rollup(V.epochs(spark, d), ["loss", "val_loss"], ["n_labels"], {"label_mean": "n_labels"})


@query("a15_epoch_rollup", with_("epochs", HISTORY) + f"""
select epoch, n_batches, {rs('loss', 'val_loss')}, n_labels, {r('label_mean')} from hist""")
def a15(spark, d):
    return tidy(history(spark, d))


@query("a16_best_epoch", with_("epochs", HISTORY) + f"""
select * from (select 'val_loss' as metric, epoch as best_epoch, {r('val_loss', 'best_score')} from hist where epoch <> 3 order by val_loss, epoch limit 1)
union all select * from (select 'label_mean', epoch, {r('label_mean')} from hist order by label_mean desc, epoch limit 1)""")
def a16(spark, d):
    h = history(spark, d)
    return tidy(R.best_epoch(h, "val_loss", F.col("epoch") != 3).unionByName(R.best_epoch(h, "label_mean")))


@query("a17_param_summary", with_("epochs") + f"""
select epoch, {r('avg(label_mean)', 'mean')}, {r('quantile_cont(label_mean, 0.05)', 'p05')}, {r('quantile_cont(label_mean, 0.5)', 'p50')}, {r('quantile_cont(label_mean, 0.95)', 'p95')}
from epochs group by epoch""")
def a17(spark, d):
    return tidy(R.param_summary(V.epochs(spark, d), "label_mean", ["epoch"]))


@query("a18_reduce_samples", with_("ensemble") + f"""
select window_id, i, {r('avg(sample)', 'mean_sample')}, {r('quantile_disc(sample, 0.5)', 'median_sample')} from ensemble group by window_id, i""")
def a18(spark, d):
    e = V.ensemble(spark, d)
    mean = E.reduce_samples(e, ["window_id", "i"], "sample", "mean").withColumnRenamed("reduced", "mean_sample")
    mid = E.reduce_samples(e, ["window_id", "i"], "sample", "median").withColumnRenamed("reduced", "median_sample")
    return tidy(mean.join(mid, ["window_id", "i"]))


@query("a19_pool_embeddings", with_("case_embeddings", ("u", """
select case_key // 4 as c, unnest(range(len(embedding))) as pos, unnest(embedding) as x from case_embeddings""")) + f"""
select c as case_key, cast(pos as int) as pos, {r('avg(cast(x as double))', 'x')}, count(*) as n_segments from u group by c, pos""")
def a19(spark, d):
    c = V.case_embeddings(spark, d).withColumn("case_key", F.floor(F.col("case_key") / 4))
    p = L.pool_embeddings(c, dim=64)
    return tidy(p.select("case_key", "n_segments", F.posexplode("embedding").alias("pos", "x")))


# ---------------------------------------------------------------- linear models

FIT = [*TRANSIT, *PAIRS, ("fit", "select *, 1.0 / ptt_sec as f from beats where split = 'train' and ptt_sec > 0"), ("model", """
select count(f) as n_fit_beats, avg(f) as feature_mean, stddev_pop(f) as feature_std, regr_intercept(sbp_true, f) as sbp_intercept, regr_slope(sbp_true, f) as sbp_slope,
 regr_intercept(dbp_true, f) as dbp_intercept, regr_slope(dbp_true, f) as dbp_slope, regr_intercept(map_true, f) as map_intercept, regr_slope(map_true, f) as map_slope,
 regr_syy(sbp_true, f) - regr_slope(sbp_true, f) * regr_sxy(sbp_true, f) as sbp_rss from fit""")]
SPLIT_KEYS = ("split", "subject_id", "record_id")


def positive_beats(spark, d):
    return X.extract_beats(V.samples(spark, d), keys=SPLIT_KEYS, **EXTRACT)[0].where("ptt_sec > 0")


@query("l1_fit_ptt", with_(*FIT) + f"""
select n_fit_beats, {rs('feature_mean', 'feature_std', 'sbp_intercept', 'sbp_slope', 'dbp_intercept', 'dbp_slope', 'map_intercept', 'map_slope')}, round(sbp_rss, 4) as sbp_rss, false as rank_deficient from model""")
def l1(spark, d):
    m = X.fit_ptt(positive_beats(spark, d).where("split = 'train'"))
    return tidy(m.drop("dbp_rss", "map_rss").withColumn("sbp_rss", F.round("sbp_rss", 4)))


@query("l2_predict_ptt", with_(*FIT) + f"""
select record_id, cast(r as bigint) as r, {r('sbp_intercept + sbp_slope / ptt_sec', 'sbp_pred')}, {r('map_intercept + map_slope / ptt_sec', 'map_pred')} from beats, model where split = 'test' and ptt_sec > 0""")
def l2(spark, d):
    b = positive_beats(spark, d)
    p = X.predict_ptt(b.where("split = 'test'"), X.fit_ptt(b.where("split = 'train'")))
    return tidy(p.select("record_id", "r", "sbp_pred", "map_pred"))


SCALER = ("sc", """
select pos, avg(x) as mean, case when stddev_pop(x) > 0 then stddev_pop(x) else 1 end as scale from (
 select unnest(range(len(embedding))) as pos, cast(unnest(embedding) as double) as x from case_embeddings where case_key % 5 <> 0) group by pos""")


@query("l3_fit_scaler", with_("case_embeddings", SCALER) + f"select cast(pos as int) as pos, {rs('mean', 'scale')} from sc")
def l3(spark, d):
    return tidy(L.fit_scaler(V.case_embeddings(spark, d).where(F.col("case_key") % 5 != 0)))


@query("l3_apply_scaler", with_("case_embeddings", SCALER, ("u", """
select case_key, unnest(range(len(embedding))) as pos, cast(unnest(embedding) as double) as x from case_embeddings where case_key % 5 = 0""")) + f"""
select case_key, cast(u.pos as int) as pos, {r('(x - mean) / scale', 'x')} from u join sc using (pos)""")
def l3b(spark, d):
    c = V.case_embeddings(spark, d)
    s = L.fit_scaler(c.where(F.col("case_key") % 5 != 0))
    out = L.apply_scaler(c.where(F.col("case_key") % 5 == 0), s)
    return tidy(out.select("case_key", F.posexplode("scaled").alias("pos", "x")))


@query("l4_gram_matrix", with_("case_embeddings", ("u", """
select case_key, unnest(range(len(embedding))) as pos, cast(unnest(embedding) as double) as x from case_embeddings""")) + f"""
select cast(a.pos as int) as a, cast(b.pos as int) as b, {r('sum(a.x * b.x)', 'total')} from u a join u b using (case_key) group by a.pos, b.pos""")
def l4(spark, d):
    return tidy(L.gram_matrix(V.case_embeddings(spark, d)))


# The solution is the one vector that leaves nothing of the normal equations.
@query("l4_fit_ridge", with_("case_embeddings", ("u", """
select case_key, target, unnest(range(len(embedding))) as pos, cast(unnest(embedding) as double) as x from case_embeddings""")) + f"""
select cast(pos as int) as pos, {r('avg(x)', 'mean')}, {r('case when stddev_pop(x) > 0 then stddev_pop(x) else 1.0 end', 'scale')},
 {r('(select avg(target) from case_embeddings)', 'intercept')}, 0.0 as residual from u group by pos""")
def l4b(spark, d):
    c = V.case_embeddings(spark, d)
    left = L.normal_equations(c, L.fit_ridge(c, "target", 10.0, 64), "target")
    return tidy(left.withColumn("residual", F.round("residual", 6)))


def folded(spark, d):
    return D.kfold(V.case_embeddings(spark, d), 4, ["case_key"], [F.floor(F.col("case_key") / 4096)])


@query("l5_select_alpha")
def l5(spark, d):
    _, scores = L.fit_ridge_cv(folded(spark, d), ["target"], "fold", 64)
    return tidy(spark.createDataFrame(scores, "target string, alpha double, mean_test_mse double"))


@query("l6_predict_ridge")
def l6(spark, d):
    c = folded(spark, d)
    m, _ = L.fit_ridge_cv(c.where(F.col("case_key") % 5 != 0), ["target"], "fold", 64)
    return tidy(L.predict_ridge(c.where(F.col("case_key") % 5 == 0), m["target"], "pred").select("case_key", "target", "pred"))


@query("l7_predict_windows", with_("points") + f"""
select subject_id, window_id, count(*) as n, {r('coalesce(avg(y_true), 0) * 0.1333223684 + 40', 'level')} from points group by subject_id, window_id""")
def l7(spark, d):
    def model(pdf):
        mean = [pd.Series(a, dtype="float64").mean() for a in pdf["y_true"]]
        return pd.DataFrame({"n": [len(a) for a in pdf["y_true"]], "level": pd.Series(mean).fillna(0.0) * 0.1333223684 + 40})
    return tidy(L.predict_windows(V.windows(spark, d), model, "subject_id bigint, window_id bigint, n bigint, level double",
                                  ["subject_id", "window_id"]))
