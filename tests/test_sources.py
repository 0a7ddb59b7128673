"""Readers, writers, labels, and the transit job on a drawn recording."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.functions import features, text as T
from pulsemill.operators import transit as X, windows
from pulsemill.plans import documents, jobs
from pulsemill.sources import manifests, records, results
from pulsemill.sources.storage import scratch_path
from pulsemill.streaming import running


def test_labels(spark):
    df = spark.createDataFrame([(" Training ", "MIMIC-IV"), ("holdout", "  "), ("Testing", "Other X")], "s string, o string")
    got = df.select(T.canonical_split("s").alias("s"), T.canonical_source("o").alias("o")).collect()
    assert [tuple(r) for r in got] == [("train", "mimic4wdb"), (None, None), ("test", "other x")]


def test_last_duplicate_column_wins(spark):
    df = spark.createDataFrame([(["ppg", "P-P_G", "x"],), (["pleth", "PPG"],), (["x"],)], "c array<string>")
    got = [r.v for r in df.select(T.resolve_column("c", ["PLETH", "PPG"]).alias("v")).collect()]
    assert got == ["P-P_G", "pleth", None]


def test_tokens(spark):
    df = spark.createDataFrame([(" a b/", 5), ("__", 123456789)], "t string, n bigint")
    got = df.select(T.safe_token("t").alias("t"), T.window_id(F.lit("test"), "n").alias("w")).collect()
    assert [tuple(r) for r in got] == [("a_b", "test_00000005"), ("record", "test_123456789")]


def test_files_that_cannot_be_read(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad.parquet")
    spark.createDataFrame([(125.0, 1.0, 2.0, 3.0)], "fs double, II double, ppg double, Art double").coalesce(1).write.parquet(good)
    open(bad, "w").write("no parquet")
    import glob
    paths = [glob.glob(good + "/*.parquet")[0], bad, str(tmp_path / "gone.parquet")]
    df = spark.createDataFrame([(p,) for p in paths], "parquet string")
    got = {r.parquet: r for r in manifests.inspect_record_files(df).collect()}
    assert got[paths[0]].qualified and got[paths[0]].file_fs == 125.0 and got[paths[0]].abp_col == "Art"
    assert got[paths[1]].file_exists and got[paths[1]].read_error and not got[paths[1]].qualified
    assert not got[paths[2]].file_exists


def test_tables_refuse_other_headers(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("m", 1)], "a string, b int")
    results.append_table(a, path, ["a", "b"])
    results.append_table(a, path, ["a", "b"])
    with pytest.raises(ValueError):
        results.append_table(a, path, ["b", "a"])
    assert spark.read.csv(path, header=True).count() == 2
    results.append_table(a, path, ["b", "a"], overwrite=True)
    assert spark.read.csv(path, header=True).columns == ["b", "a"]


def test_bad_decay_segments_raise(spark, tmp_path):
    schema = "window_key string, dia_start int, dia_end int, p_inf double, target_T int"
    for k, rows in enumerate([[("a", 5, 5, 1.0, 9)], [("a", 1, 5, float("nan"), 9)], [("a", 1, 5, 1.0, 0)], []]):
        path = str(tmp_path / f"s{k}")
        spark.createDataFrame(rows, schema).write.parquet(path)
        with pytest.raises(ValueError):
            results.read_tau_segments(spark, path)


def test_meta_filled_only_when_entirely_missing(spark):
    s = spark.createDataFrame([("r", 0, None, "x"), ("r", 1, None, None), ("q", 0, 50.0, None)],
                              "record_id string, i int, fs double, hadm_id string").withColumns(
        {c: F.lit(1.0) for c in ("ecg", "ppg", "abp")})
    m = spark.createDataFrame([("r", "s1", 100.0, "h", "test", "src"), ("q", "s2", 60.0, "g", "val", "src")],
                              "record_id string, subject_id string, fs double, hadm_id string, split string, source string")
    got = {(r.record_id, r.i): (r.fs, r.subject_id, r.hadm_id, r.split) for r in records.standardize_records(s, m).collect()}
    assert got == {("r", 0): (100.0, "s1", "x", "test"), ("r", 1): (100.0, "s1", None, "test"), ("q", 0): (50.0, "s2", "g", "val")}


def test_cuff_features(spark):
    df = spark.createDataFrame([(130.0, 80.0, 100.0, 60.0, True), (130.0, None, 100.0, 60.0, True), (1.0, 1.0, 1.0, 1.0, False)],
                               "s double, d double, m double, t double, v boolean")
    cols = dict(sbp="s", dbp="d", map_="m", delta_sec="t", valid="v")
    got = [r.cuff for r in features.with_cuff_features(df, **cols).collect()]
    np.testing.assert_allclose(got[0], [0.25, 0.4, 1 / 3, 0.0, 0.1, 1.0])
    np.testing.assert_allclose(got[1], [-3.0, -2.8, -3.0, -5 / 3, 0.0, 0.0])
    with pytest.raises(Exception, match="cuff"):
        features.with_cuff_features(df, require_all_valid=True, **cols).collect()


def drawn(fs=100, beats=30, delay=0.2):
    """An ecg with spikes, a pulse that dips `delay` seconds later, a pressure wave."""
    n = fs * beats
    t = np.arange(n) / fs
    ecg = np.exp(-((t % 1.0 - 0.3) / 0.01) ** 2)
    ppg = -np.exp(-((t % 1.0 - 0.3 - delay) / 0.03) ** 2)
    abp = 90 + 30 * np.sin(2 * np.pi * t)
    return ecg, ppg, abp


def test_transit_time_of_a_drawn_recording(spark):
    rows = []
    for rec, (split, delay) in enumerate([("train", 0.15), ("train", 0.25), ("test", 0.2)]):
        ecg, ppg, abp = drawn(delay=delay)
        rows += [(split, rec, rec, i, 100.0, float(a), float(b), float(c + 10 * rec)) for i, (a, b, c) in enumerate(zip(ecg, ppg, abp))]
    df = spark.createDataFrame(rows, "split string, subject_id int, record_id int, i bigint, fs double, ecg double, ppg double, abp double")
    out = jobs.transit_benchmark(df, keys=("split", "subject_id", "record_id"))
    beats = out["beats"].collect()
    assert {(r.record_id, round(r.ptt_sec, 2)) for r in beats} == {(0, 0.15), (1, 0.25), (2, 0.2)}
    assert len(beats) == 3 * 29  # the last foot has no next one
    m = out["model"].first()
    x = np.array([1 / r.ptt_sec for r in beats if r.split == "train"])
    y = np.array([r.sbp_true for r in beats if r.split == "train"])
    slope, base = np.polyfit(x, y, 1)
    assert m.sbp_slope == pytest.approx(slope) and m.sbp_intercept == pytest.approx(base)
    report = X.extraction_report(df, out["beats"], out["labelled"], out["feet"], out["segments"],
                                 ("split", "subject_id", "record_id")).first()
    assert (report.records, report.r_peaks, report.paired_beats, report.dropped_no_next_ppg_foot) == (3, 90, 87, 3)


def test_one_foot_counts_as_none(spark):
    r = spark.createDataFrame([(1, 0, 50, 100.0, 10), (2, 0, 50, 100.0, 10)], "record_id int, seg_start bigint, seg_end bigint, fs double, r bigint")
    f = spark.createDataFrame([(1, 0, 50, 100.0, 30), (2, 0, 50, 100.0, 5), (2, 0, 50, 100.0, 30)], "record_id int, seg_start bigint, seg_end bigint, fs double, foot bigint")
    got = {r.record_id: r.drop_reason for r in X.label_r_peaks(r, f).collect()}
    assert got == {1: "no_ppg_foot", 2: "no_next_ppg_foot"}


def test_nested_documents_are_cleaned(spark):
    path = scratch_path(spark, "nested")
    df = spark.sql("select named_struct('z', double('NaN'), 'a', 1.5D, 'l', array(double('Infinity'), 2D)) as m, 1 as b, "
                   "cast(null as struct<x: double>) as n")
    results.write_metrics_json(df, path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"b":1,"m":{"a":1.5,"l":[null,2.0],"z":null},"n":null}']


def test_funnel_counts_records_without_a_window(spark):
    rows = [("train", "s", "long", i, 4.0, float(i)) for i in range(8)] + [("train", "s", "brief", 0, 4.0, 1.0)]
    samples = spark.createDataFrame(rows, "split string, subject_id string, record_id string, i long, fs double, ppg double")
    made = windows.fixed_windows(samples, 1.0, 1.0, ["ppg"], keep_all=True)
    r = windows.window_funnel(made, records=samples).collect()
    assert [(x.records, x.candidate_windows, x.kept_windows) for x in r] == [(2, 2, 2)]


def test_funnel_tells_records_of_two_subjects_apart(spark):
    rows = [("train", s, 7, i, 4.0, float(i)) for s in (1, 2) for i in range(8)]
    samples = spark.createDataFrame(rows, "split string, subject_id int, record_id int, i long, fs double, ppg double")
    made = windows.fixed_windows(samples, 1.0, 1.0, ["ppg"], keep_all=True)
    assert windows.window_funnel(made, records=samples).first().records == 2
    ordered = windows.assign_index(made, ["subject_id", "record_id", "window_index"]).orderBy("memmap_index").collect()
    assert [(r.subject_id, r.window_index, r.memmap_index) for r in ordered] == [(1, 0, 0), (1, 1, 1), (2, 0, 2), (2, 1, 3)]


def test_preparation_refuses_empty_splits_and_long_keeps(spark):
    rows = [("train", "s", "a", i, 4.0, float(i), 1.0) for i in range(8)] + [("test", "s", "b", 0, 4.0, 1.0, 1.0)]
    samples = spark.createDataFrame(
        rows, "split string, subject_id string, record_id string, i long, fs double, ppg double, abp double")
    with pytest.raises(ValueError, match="test"):
        jobs.prepare_windows(samples, 1.0, 1.0, 4)
    with pytest.raises(ValueError, match="keep"):
        jobs.prepare_windows(samples, 1.0, 1.0, 4, keep=5)


def test_metrics_document_of_a_waveform_run(spark):
    """Run totals, the check's report, and what the seeds' aggregation reads."""
    rng = np.random.default_rng(0)
    rows = [(f"s{k % 3}", k, [float(80 + 30 * np.sin(i / 3.0) + rng.normal()) for i in range(40)],
             [float(80 + 30 * np.sin(i / 3.0)) for i in range(40)]) for k in range(9)] + [("s9", 9, [80.0] * 40, [80.0] * 40)]
    df = spark.createDataFrame(rows, "subject_id string, window_id long, y_true array<double>, y_pred array<double>")
    result = jobs.patient_metrics_waveform(df, 4.0, n_bootstrap=20, reference_qc={})
    path = scratch_path(spark, "document")
    documents.write_metrics_document(result, path, "demo", protocol={"shift_ms": 250.0})
    d = spark.read.json(f"{path}/document").first()
    assert (d.method, d.n_patients, d.n_windows, d.n_windows_original, d.n_points) == ("demo", 4, 9, 10, 360)
    assert d.max_shift_samples == round(0.25 * 40 / 4.0)
    assert (d.reference_qc.enabled, d.reference_qc.n_windows_valid, d.reference_qc.below_min_std) == (True, 9, 1)
    assert d.patient_summary.waveform.mae_mmHg.n_patients == 3 and d.pooled_scalar.sbp.n_beats > 0
    assert spark.read.json(f"{path}/patients").count() == 4
    seeds = {r.metric: r.value for r in results.read_seed_runs(spark, {"a": f"{path}/document"}).collect()}
    assert seeds["MAE"] == d.patient_summary.waveform.mae_mmHg.mean and seeds["SBP ME"] == d.pooled_scalar.sbp.bias


def test_one_record_of_an_export_scans_its_bucket(spark):
    rows = [("train" if r % 2 else "test", f"s{r % 3}", r, 4.0, i, float(i), float(i), float(i), "h", "src")
            for r in range(40) for i in range(30)]
    samples = spark.createDataFrame(rows, "split string, subject_id string, record_id long, fs double, i long, "
                                          "II double, PLETH double, ABP double, hadm_id string, source string")
    manifest = samples.select("split", "subject_id", "record_id", "fs", "hadm_id", "source").distinct().withColumns({
        "parquet": F.lit("p"), "source_manifest": F.lit("m"), "source_row_index": F.col("record_id")})
    path = scratch_path(spark, "export")
    listed = records.export_method_view(samples, manifest, "unicardio", path)
    one = records.read_record(spark, path, "train", "s1", 7)
    assert sorted(r.i for r in one.collect()) == list(range(30)) and {r.record_id for r in one.collect()} == {7}
    plan = one._jdf.queryExecution().executedPlan().toString()
    scan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "record_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert len(one.inputFiles()) >= 1 and "pmod(xxhash64" not in scan
    assert all(f"record_bucket={b}/" in f"{r.exported_parquet}/" for r in listed.collect()
               for b in [r.exported_parquet.rsplit("=", 1)[1]])
    back = records.read_export(spark, listed.where("record_id in (3, 7, 8)"))
    assert back.count() == 90 and "record_bucket" not in back.columns


def test_stream_windows_equal_batch_windows(spark):
    """Samples out of order over several batches, gaps, a window that never becomes whole, and a late row."""
    rng = np.random.default_rng(3)
    rows = [(r, int(i), 4.0, float(rng.normal())) for r in range(3) for i in range(60) if (r, i) not in ((1, 20), (2, 0))]
    df = spark.createDataFrame(rows, "record_id long, i long, fs double, x double").withColumn(
        "time", F.timestamp_seconds(F.lit(1.6e9) + F.col("i") / F.col("fs")))
    source, out, mark = (scratch_path(spark, n) for n in ("in", "out", "mark"))
    for part in (df.where("i % 3 = 0"), df.where("i % 3 = 1"), df.where("i % 3 = 2")):
        part.coalesce(1).write.mode("append").parquet(source)
    late = spark.createDataFrame([(1, 20, 4.0, 9.0)], "record_id long, i long, fs double, x double").withColumn(
        "time", F.timestamp_seconds(F.lit(1.6e9) + F.col("i") / F.col("fs")))
    arriving = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    made = running.record_windows(arriving, "time", 3.0, 1.0, ["x"], ["record_id"], "1 hour")
    running.drain(made, out, mark)
    want = {(r.record_id, r.window_index): r.x for r in windows.fixed_windows(df, 3.0, 1.0, ["x"], ["record_id"]).collect()}
    read = lambda: {(r.record_id, r.window_index): r.x for r in spark.read.parquet(out).collect()}
    assert read() == want and spark.read.parquet(out).count() == len(want) > 0
    # Far later samples move the watermark on; the missing sample then comes too late.
    df.limit(1).withColumns({"i": F.lit(100_000).cast("long"), "time": F.timestamp_seconds(F.lit(1.6e9 + 25_000))}).write.mode("append").parquet(source)
    running.drain(made, out, mark)
    late.write.mode("append").parquet(source)
    running.drain(made, out, mark)
    assert read() == want


def test_record_files_are_written_by_the_tasks(spark):
    from checks import manifest_queries as M
    # A record of several Arrow batches, a short one, and one of another spelling.
    sizes = {3: 25_000, 6: 1, 7: 40}
    rows = spark.createDataFrame([(r, i, float(i), None, 2.0) for r, n in sizes.items() for i in range(n)],
                                 "rec bigint, i bigint, ecg double, ppg double, abp double").repartition(3)
    files = M.write_record_files(rows, scratch_path(spark, "record-files"))
    paths = [r.parquet for r in files.collect()]
    assert len(paths) == 3 and sorted(int(p.split("rec=")[1].split("/")[0]) for p in paths) == [3, 6, 7]
    for p in paths:
        rec = int(p.split("rec=")[1].split("/")[0])
        got = spark.read.parquet(p)
        assert got.columns == [*M.SPELLINGS[rec % 3], "note"]
        assert [r[0] for r in got.select("_metadata.row_index", got.columns[0]).orderBy("row_index").select(got.columns[0]).collect()] \
            == [float(i) for i in range(sizes[rec])]
