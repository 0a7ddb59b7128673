"""End-to-end jobs and streaming forms."""

from pyspark.sql import functions as F

from checks import views as V
from checks.manifest_queries import err_sql, summary_sql
from checks.metric_queries import (BEAT_ERR, DIST, PATIENT_LONG, PATIENT_SQL, FIT, SPLIT_KEYS, boot_sql,
                                   case_labels, folded, wave_sql)
from checks.registry import query, r, rs, tidy, with_
from checks.signal_queries import BASE, BASE3, EXTRACT, PAIRS, TRANSIT, long, resample_sql
from pulsemill.operators.patients import aggregate_seeds
from pulsemill.plans import documents, jobs
from pulsemill.sources import results
from pulsemill.sources.storage import scratch_path
from pulsemill.streaming import running

FIT_LOG = [*TRANSIT, *PAIRS, ("fit", "select *, 1.0 / ptt_sec as f from beats where split in ('train', 'val') and ptt_sec > 0"), FIT[-1],
           ("scalar_preds", """
select sbp_true, dbp_true, map_true, case when ptt_sec > 0 then sbp_intercept + sbp_slope / ptt_sec end as sbp_pred,
 case when ptt_sec > 0 then dbp_intercept + dbp_slope / ptt_sec end as dbp_pred, case when ptt_sec > 0 then map_intercept + map_slope / ptt_sec end as map_pred
from beats, model where split = 'test'""")]


@query("j1_transit_benchmark", with_(*FIT_LOG, err_sql("scalar_preds")) + summary_sql("err", ["metric"]))
def j1(spark, d):
    out = jobs.transit_benchmark(V.samples(spark, d), fit_splits=("train", "val"), keys=SPLIT_KEYS, **EXTRACT)
    return tidy(out["summary"])


@query("j2_evaluate_waveforms", with_("points", *BEAT_ERR, ("w", wave_sql("points")), ("s", summary_sql("err", ["metric"]))) + """
select s.metric, s.n_beats, s.mae, s.bias, s.std, s.bhs_grade, s.aami_compliant, w.n_points, w.waveform_mae, w.waveform_rmse, w.waveform_corr from s, w""")
def j2(spark, d):
    w = V.windows(spark, d)
    unit = w.withColumns({c: F.transform(c, lambda v: (v - 100.0) / 50.0) for c in ("y_true", "y_pred")})
    wave, scalar = jobs.evaluate_waveforms(unit, 4.0, 50.0, 100.0)
    out = scalar.withColumn("__w", wave.select(F.struct("*")).scalar())
    return tidy(out.select("metric", "n_beats", "mae", "bias", "std", "bhs_grade", "aami_compliant",
                           "__w.n_points", "__w.waveform_mae", "__w.waveform_rmse", "__w.waveform_corr"))


# Windows that pass the check of the truth replace the points of every later step.
QC_POINTS = ("points", """
select * from all_points where window_id in (select window_id from all_points group by window_id
 having count(y_true) = count(*) and min(y_true) >= 20 and max(y_true) <= 250 and stddev_pop(y_true) >= 1 and max(y_true) - min(y_true) between 10 and 95)""")
WAVE_LONG = ("plong", " union all ".join(
    [f"select subject_id, '{m}' as metric, {c} as value from patient" for m, c in (
        ("mae_mmHg", "mae"), ("rmse_mmHg", "rmse"), ("min_mae_mmHg", "min_mae"), ("min_rmse_mmHg", "min_rmse"), ("nrmse", "nrmse"), ("corr", "corr"))]
    + [f"select subject_id, metric || '_{v}_mmHg', {v} from scalar_p" for v in ("mae", "rmse")]))
WAVE_SCALAR = ("scalar_p", """
select subject_id, metric, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse from err join (select distinct window_id, subject_id from points) using (window_id) group by subject_id, metric""")


@query("j3_patient_metrics_waveform", with_(("all_points", V.SQL["points"]), QC_POINTS, *PATIENT_SQL, *BEAT_ERR, WAVE_SCALAR, WAVE_LONG,
       ("long_f", "select * from plong where value is not null"), (DIST[0], DIST[1].replace("plong", "long_f")), *boot_sql("long_f", 2000)) + f"""
select metric, n_patients, {", ".join(f"round({c}, 6) + 0.0 as {c}" for c in ('mean', 'iqr_low', 'median', 'iqr_high', 'ci_low', 'ci_high'))} from dist join ci using (metric)""")
def j3(spark, d):
    out = jobs.patient_metrics_waveform(V.windows(spark, d), 4.0, reference_qc={"max_range": 95.0})
    return out["summary"].select("metric", "n_patients", *[
        (F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean", "iqr_low", "median", "iqr_high", "ci_low", "ci_high")])


@query("j4_patient_metrics_scalar", with_(("sp0", V.SQL["scalar_preds"]), ("labels_v", """
select case_key, max(subject_id) as subject_id from (select l_orderkey as case_key, l_suppkey as subject_id from lineitem where l_orderkey % 5 <> 0) group by case_key"""),
       ("scalar_preds", """
select coalesce(cast(l.subject_id as varchar), cast(p.case_key as varchar)) as subject_id, p.* exclude (subject_id) from sp0 p left join labels_v l on l.case_key = p.case_key
where sbp_true - dbp_true between 50 and 65 and dbp_true >= 20 and sbp_true <= 250"""),
       err_sql("scalar_preds", "subject_id, "), *PATIENT_LONG, DIST, *boot_sql("plong", 2000)) + f"""
select metric, n_patients, {rs('mean', 'iqr_low', 'median', 'iqr_high', 'ci_low', 'ci_high')} from dist join ci using (metric)""")
def j4(spark, d):
    p = V.scalar_preds(spark, d).drop("subject_id")
    out = jobs.patient_metrics_scalar(p, case_labels(spark, d),
                                      reference_qc={"min_range": 50.0, "max_range": 65.0})
    return tidy(out["summary"].select("metric", "n_patients", "mean", "iqr_low", "median", "iqr_high", "ci_low", "ci_high"))


QC_BOUNDS = {"min_range": 50.0, "max_range": 65.0}


@query("j4_metrics_document", with_(("sp0", V.SQL["scalar_preds"]), ("scalar_preds", """
select cast(subject_id as varchar) as subject_id, * exclude (subject_id) from sp0 where sbp_true - dbp_true between 50 and 65 and dbp_true >= 20 and sbp_true <= 250"""),
       err_sql("scalar_preds", "subject_id, "), *PATIENT_LONG, DIST, ("pool", "select metric, avg(e) as bias, stddev_pop(e) as std from err group by metric")) + f"""
select 'demo' as method, (select count(distinct subject_id) from scalar_preds) as n_patients, (select count(*) from scalar_preds) as n_scalar_predictions,
 (select count(*) from sp0) as n_scalar_predictions_original, (select count(*) from sp0) - (select count(*) from scalar_preds) as n_scalar_excluded,
 {r("(select mean from dist where metric = 'sbp_mae_mmHg')", 'sbp_mae')}, {r("(select median from dist where metric = 'map_rmse_mmHg')", 'map_rmse_median')},
 {r("(select bias from pool where metric = 'dbp')", 'dbp_bias')}, {r("(select std from pool where metric = 'map')", 'map_std')}, cast(3 as bigint) as seed_values""")
def j4_document(spark, d):
    result = jobs.patient_metrics_scalar(V.scalar_preds(spark, d), reference_qc=QC_BOUNDS, n_bootstrap=20)
    path = scratch_path(spark, "run")
    documents.write_metrics_document(result, path, "demo")
    fields = {"n_patients": "n_patients", "n_scalar_predictions": "n_scalar_predictions",
              "n_scalar_predictions_original": "n_scalar_predictions_original", "n_scalar_excluded": "reference_qc.n_scalar_excluded",
              "sbp_mae": "patient_summary.scalar.sbp_mae_mmHg.mean", "map_rmse_median": "patient_summary.scalar.map_rmse_mmHg.median",
              "dbp_bias": "pooled_scalar.dbp.bias", "map_std": "pooled_scalar.map.std"}
    read = results.read_metrics_json(spark, f"{path}/document", fields).where("n_patients is not null")
    # The seeds' aggregation reads the same document.
    seeds = aggregate_seeds(results.read_seed_runs(spark, {"a": f"{path}/document"})).where(
        "metric in ('SBP err', 'DBP ME', 'MAP error SD') and n_seeds = 1").agg(F.count(F.lit(1)))
    counts = [F.col(c).cast("bigint").alias(c) for c in list(fields)[:4]]
    return tidy(read.select(F.lit("demo").alias("method"), *counts, *list(fields)[4:], seeds.scalar().alias("seed_values")))


@query("j5_prepare_minmax", with_(*BASE, ("rs", resample_sql("wp", 16, 20, 16, ["ppg", "abp"])), ("k", """
select min(ppg) as p0, max(ppg) as p1, min(abp) as a0, max(abp) as a1 from rs where split in ('train', 'val')"""), ("idx", """
select split, record_id, window_index, row_number() over (partition by split order by record_id, window_index) - 1 as memmap_index from win where n_bad = 0""")) + f"""
select split, record_id, window_index, split || '_' || lpad(cast(memmap_index as varchar), 8, '0') as window_id, {r('sum((ppg - p0) / (p1 - p0))', 'ppg_sum')},
 {r('sum((abp - a0) / (a1 - a0))', 'abp_sum')} from rs join idx using (split, record_id, window_index), k group by split, record_id, window_index, memmap_index""")
def j5(spark, d):
    out = jobs.prepare_windows(V.samples(spark, d), 4.0, 2.0, 20, 16, "minmax")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return tidy(out["windows"].select("split", "record_id", "window_index", "window_id",
                                      total("ppg").alias("ppg_sum"), total("abp").alias("abp_sum")))


UNIT = lambda c: f"-1.0 + 2.0 * ({c} - min({c}) over v) / nullif(max({c}) over v - min({c}) over v, 0)"


@query("j5_prepare_slots", with_(("samples", V.few_gaps_sql()), *BASE3[1:], ("rs", resample_sql("wp", 16, 20, 20, ["ppg", "abp", "ecg"])), ("u", f"""
select *, {UNIT('ppg')} as up, {UNIT('ecg')} as ue from rs window v as (partition by split, record_id, window_index)"""), ("f", """
select split, record_id, window_index, pos as p, up as x from u union all select split, record_id, window_index, pos + 20, (abp - 100) / 50 from u
 union all select split, record_id, window_index, pos + 40, ue from u union all select split, record_id, window_index, pos + 60, 0.0 from u""")) + f"""
select split, record_id, window_index, cast(p as int) as pos, {r('x', 'full_signal')} from f""")
def j5b(spark, d):
    out = jobs.prepare_windows(V.samples(spark, d, V.FEW_GAPS), 4.0, 2.0, 20, None, "slots", cols=("ppg", "abp", "ecg"))
    return long(out["windows"], "full_signal")


@query("j6_embedding_probe")
def j6(spark, d):
    c = V.case_embeddings(spark, d)
    fit = folded(spark, d).where(F.col("case_key") % 5 != 0).select("case_key", "fold")
    out = jobs.embedding_probe(c.select("case_key", "embedding"), c.select("case_key", "target"), ["target"], 64,
                               fit, c.where(F.col("case_key") % 5 == 0))
    return tidy(out["summary"])


# ---------------------------------------------------------------- streaming

def stream(spark, d, name):
    schema = V.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("x1_running_waveform_metrics", with_("points") + wave_sql("points", ["subject_id"]))
def x1(spark, d):
    w = F.floor(F.col("l_orderkey") / 8.0)
    rows = stream(spark, d, "lineitem").select((w % 97).alias("subject_id"), *[c.alias(n) for n, c in V._pair(None).items()])
    path, mark = scratch_path(spark, "running"), scratch_path(spark, "running-state")
    running.drain_complete(running.running_waveform_metrics(rows, ["subject_id"]), path, mark)
    return tidy(spark.read.parquet(path))


# Windows that end before the last time seen less the delay have been given out.
@query("x2_event_windows_qc", f"""
with e as (select event_type, value, ts, (select max(ts) from events) - interval 10 minutes as seen from events),
w as (select *, unnest([time_bucket(interval 3 hours, ts, timestamp '1970-01-01'), time_bucket(interval 3 hours, ts, timestamp '1970-01-01') - interval 3 hours]) as window_start from e),
g as (select event_type, window_start, window_start + interval 6 hours as window_end, count(*) as n, count(value) as n_finite, min(value) as lo, max(value) as hi, avg(value) as mean
 from w where window_start + interval 6 hours <= seen group by event_type, window_start)
select event_type, cast(epoch(window_start) as bigint) as window_start, cast(epoch(window_end) as bigint) as window_end, n, n_finite, {rs('lo', 'hi', 'mean')},
 coalesce(n = n_finite and lo >= 0 and hi <= 250, false) as valid from g""")
def x2(spark, d):
    rows = stream(spark, d, "events").withColumn("time", F.col("ts").cast("timestamp"))
    path, mark = scratch_path(spark, "event-windows"), scratch_path(spark, "event-windows-state")
    out = running.event_windows_qc(rows, "time", "value", ["event_type"], "6 hours", "3 hours", "10 minutes", 0.0, 250.0)
    running.drain(out, path, mark)
    seconds = {c: F.unix_timestamp(c) for c in ("window_start", "window_end")}
    return tidy(spark.read.parquet(path).withColumns(seconds))


@query("x2_record_windows", with_(*BASE) + f"""
select split, subject_id, record_id, window_index, {r('sum(ppg)', 'ppg_sum')}, {r('sum(abp * j)', 'abp_moment')} from wp
group by split, subject_id, record_id, window_index""")
def x2_records(spark, d):
    source, path, mark = (scratch_path(spark, n) for n in ("arriving", "record-windows", "record-windows-state"))
    keys = ["split", "subject_id", "record_id"]
    rows = V.samples(spark, d).withColumn("time", F.timestamp_seconds(F.lit(1.6e9) + F.col("i") / F.col("fs")))
    # Samples of all records arrive in two files, not in order.
    rows.repartition(2, F.col("i") % 2).write.parquet(source)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    made = running.record_windows(arriving, "time", 4.0, 2.0, ["ppg", "abp"], keys, "1 hour")
    running.drain(made, path, mark)
    there = lambda x: x.isNotNull() & ~F.isnan(x)
    whole = F.forall("ppg", there) & F.forall("abp", there)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return tidy(spark.read.parquet(path).where(whole).select(
        *keys, "window_index", total("ppg").alias("ppg_sum"), total(F.transform("abp", lambda x, i: x * i)).alias("abp_moment")))
