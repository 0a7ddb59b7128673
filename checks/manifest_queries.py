"""Sources and sinks, text and number functions, manifest checks, splits."""

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import query, r, rs, tidy, with_
from pulsemill.functions import features, fixed, numeric as N, text as T
from pulsemill.operators import alignment, errors, patients, quality as Q, splits as D
from pulsemill.operators.windows import (assign_index, finite_segments, fixed_windows,
                                         slice_windows, window_funnel)
from pulsemill.sources import manifests, records, results
from pulsemill.sources.storage import materialize, scratch_path

# ---------------------------------------------------------------- shared pieces

CLEAN = "lower(regexp_replace({}, '[^a-zA-Z0-9]', '', 'g'))"
SPLIT_CASE = ("case {t} when 'train' then 'train' when 'training' then 'train' when 'val' then 'val' "
              "when 'valid' then 'val' when 'validation' then 'val' when 'test' then 'test' "
              "when 'testing' then 'test' end")


def split_sql(c):
    return SPLIT_CASE.format(t=CLEAN.format(c))


def source_sql(c):
    t = CLEAN.format(c)
    return (f"case when trim({c}) = '' then null when {t} in ('vitaldb', 'vital') then 'vitaldb' "
            f"when {t} in ('mimic4', 'mimic4wdb', 'mimiciv', 'mimicivwdb') then 'mimic4wdb' "
            f"when {t} in ('mimic2', 'mimic2co', 'mimiciico') then 'mimic2co' "
            f"else lower(trim({c})) end")


def resolve_sql(*aliases):
    tries = [f"list_filter(string_split(columns_csv, ','), lambda c: {CLEAN.format('c')} = '{a}')[-1]"
             for a in aliases]
    return "coalesce(" + ", ".join(tries) + ")" if len(tries) > 1 else tries[0]


FILES = ("files", f"""
select *, there and not bad as readable from (
 select *, parquet is not null and source_row_index % 23 <> 0 as there,
  parquet is not null and source_row_index % 23 <> 0 and source_row_index % 29 = 0 as bad,
  {resolve_sql('ii')} as ecg_col, {resolve_sql('pleth', 'ppg')} as ppg_col,
  {resolve_sql('abp', 'art')} as abp_col from manifest_src)""")

UNIFIED = ("unified", f"""
select {{}} as dup, split, source, cast(subject_id as varchar) as subject_id, record_id, fs, parquet,
 coalesce(ecg_col, 'II') as ecg_col, coalesce(ppg_col, 'PLETH') as ppg_col,
 coalesce(abp_col, 'ABP') as abp_col, source_row_index, there, bad, file_fs, columns_csv from files {{}}""")
UNIFIED = ("unified", UNIFIED[1].format(0, "") + " union all "
           + UNIFIED[1].format(1, "where source_row_index % 50 = 0"))


def source_manifest(spark, d):
    return V.manifest_src(spark, d).select("source_row_index", "subject_id", "record_id", "fs",
                                           "parquet", "split", "source")


def file_info(spark, d):
    k = F.col("source_row_index")
    m = V.manifest_src(spark, d).where(F.col("parquet").isNotNull() & (k % 23 != 0))
    return manifests.resolve_signals(m.select(
        "parquet", F.lit(True).alias("file_exists"),
        F.when(k % 29 == 0, "bad footer").alias("read_error"),
        F.split("columns_csv", ",").alias("columns"), "file_fs"))


def unified(spark, d):
    m = V.manifest_src(spark, d).withColumn("columns", F.split("columns_csv", ","))
    u = manifests.resolve_signals(m).select(
        "split", "source", F.col("subject_id").cast("string").alias("subject_id"), "record_id",
        F.lit(None).cast("string").alias("hadm_id"), "fs", "parquet",
        F.coalesce("ecg_col", F.lit("II")).alias("ecg_col"),
        F.coalesce("ppg_col", F.lit("PLETH")).alias("ppg_col"),
        F.coalesce("abp_col", F.lit("ABP")).alias("abp_col"),
        F.lit("customers").alias("source_manifest"), "source_row_index")
    return u.unionByName(u.where(F.col("source_row_index") % 50 == 0))


# ---------------------------------------------------------------- sources and sinks

@query("s1_read_manifest", with_("manifest_src") + """
select source_row_index, cast(subject_id as varchar) as subject_id, record_id,
 cast(null as varchar) as hadm_id, fs, parquet from manifest_src""")
def s1(spark, d):
    path = scratch_path(spark, "manifest")
    (source_manifest(spark, d).select(
        "source_row_index", "subject_id", "record_id", F.lit(None).cast("string").alias("hadm_id"),
        "fs", "parquet").write.option("header", True).csv(path))
    return manifests.read_manifest(spark, path)


@query("s2_standardize_records", with_("samples", "record_manifest") + """
select s.i, s.ecg as "II", s.ppg as "PLETH", s.abp as "ABP", s.fs, s.subject_id, m.hadm_id,
 s.record_id, m.split, m.source from samples s join record_manifest m using (record_id)""")
def s2(spark, d):
    return records.standardize_records(V.samples(spark, d), V.record_manifest(spark, d))


SPELLINGS = (("II", "PLETH", "ABP"), ("ii", "PPG", "ART"), ("II", "Pleth", "Art"))


def write_record_files(rows, root):
    """One Parquet file per record, written by the tasks as the records pass; gives the files' paths.

    Spark's writer takes long to open a file, and there are as many as records."""
    def write(batches):
        import uuid
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs
        store, base = pafs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
        now, out = None, None
        for b in batches:
            recs = b.column("rec").to_numpy()
            starts = [0, *[int(k) + 1 for k in (recs[1:] != recs[:-1]).nonzero()[0]]] if len(recs) else []
            paths = []
            for s, e in zip(starts, [*starts[1:], len(recs)]):
                rec = int(recs[s])
                part = b.slice(s, e - s)
                names = [*SPELLINGS[rec % 3], "note"]
                part = pa.table([*[part.column(c) for c in ("ecg", "ppg", "abp")], pa.array(["x"] * (e - s))], names=names)
                if rec != now:
                    if out is not None:
                        out.close()
                    # Another attempt of a task leaves files that nobody lists.
                    name = f"{rec % 3}/rec={rec}/{uuid.uuid4().hex}.parquet"
                    store.create_dir(f"{base}/{rec % 3}/rec={rec}", recursive=True)
                    now, out = rec, pq.ParquetWriter(f"{base}/{name}", part.schema, filesystem=store)
                    paths.append(f"{root}/{name}")
                out.write_table(part)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["parquet"])
        if out is not None:
            out.close()

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("rec", "i", "ecg", "ppg", "abp").repartition(spread, "rec").sortWithinPartitions("rec", "i")
    return materialize(placed.mapInArrow(write, "parquet string"))


# Three spellings of the columns; record ids repeat between subjects.
@query("s2_read_records", with_("samples", "record_manifest") + """
select s.i, s.ecg as "II", s.ppg as "PLETH", s.abp as "ABP", m.fs, cast(m.subject_id as varchar) as subject_id, m.hadm_id,
 'r' || (s.record_id % 50) as record_id, m.split, m.source from samples s join record_manifest m using (record_id)""")
def s2_files(spark, d):
    rows = V.samples(spark, d).withColumn("rec", F.col("record_id")).where("rec % 3 >= 0")
    files = write_record_files(rows, scratch_path(spark, "record-files"))
    seen = manifests.inspect_record_files(files).where("qualified").select(
        "parquet", "ecg_col", "ppg_col", "abp_col",
        F.regexp_extract("parquet", "rec=([0-9]+)", 1).cast("bigint").alias("rec"))
    listed = V.record_manifest(spark, d).drop("parquet").withColumnRenamed("record_id", "rec").join(seen, "rec")
    listed = listed.withColumns({"record_id": F.concat(F.lit("r"), (F.col("rec") % 50).cast("string")),
                                 "subject_id": F.col("subject_id").cast("string")})
    return records.read_records(spark, materialize(listed)).drop("parquet", "timestamp")


# Every file of a split looks alike, so files are told apart by their split.
@query("s3_inspect_record_files", with_("samples") + """
select distinct split, true as file_exists, 'fs,II,Pleth,ART' as columns, 'II' as ecg_col, 'Pleth' as ppg_col, 'ART' as abp_col, fs as file_fs,
 false as has_timestamp, true as qualified from samples
union all select distinct split, false, '', '', '', '', null, false, false from samples""")
def s3(spark, d):
    path = scratch_path(spark, "records")
    (V.samples(spark, d).select("fs", F.col("ecg").alias("II"), F.col("ppg").alias("Pleth"),
                                F.col("abp").alias("ART"), "split")
     .write.partitionBy("split").parquet(path))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("parquet")))
    absent = files.select(F.concat("parquet", F.lit(".gone")).alias("parquet"))
    seen = manifests.inspect_record_files(files.unionByName(absent))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c if isinstance(c, str) else "columns")
    return seen.select(F.regexp_extract("parquet", "split=([a-z]+)", 1).alias("split"), "file_exists",
                       text(F.array_join("columns", ",")), *[text(c) for c in ("ecg_col", "ppg_col", "abp_col")],
                       "file_fs", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_timestamp", "qualified")]).distinct()


PRED_COLS = ["sbp_true", "dbp_true", "map_true", "sbp_pred", "dbp_pred", "map_pred"]


@query("s4_read_scalar_predictions", with_("scalar_preds") + f"""
select subject_id, case_key, {rs(*PRED_COLS)} from scalar_preds""")
def s4(spark, d):
    path = scratch_path(spark, "preds")
    V.scalar_preds(spark, d).write.option("header", True).option("compression", "gzip").csv(path)
    schema = "subject_id bigint, case_key bigint, " + ", ".join(f"{c} double" for c in PRED_COLS)
    return tidy(results.read_scalar_predictions(spark, path, schema))


SEGMENTS_SQL = ("segs", """
select record_id, min(i) as seg_start, max(i) + 1 as seg_end from (
 select record_id, i, i - row_number() over (partition by record_id order by i) as g
 from samples where {ok}) group by record_id, g having count(*) >= {n}""")


def segments_sql(ok, n, name="segs"):
    return (name, SEGMENTS_SQL[1].format(ok=ok, n=n))


@query("s5_read_tau_segments", with_("samples", segments_sql("abp is not null", 4)) + """
select 'record_id=' || record_id as window_key, cast(0 as bigint) as dia_start,
 cast(seg_end - seg_start as bigint) as dia_end, cast(35.0 as double) as p_inf,
 cast(seg_end - seg_start as bigint) as target_T from segs""")
def s5(spark, d):
    path = scratch_path(spark, "tau")
    n = F.col("seg_end") - F.col("seg_start")
    (finite_segments(V.samples(spark, d), ["abp"], 4).select(
        T.window_key({"record_id": F.col("record_id")}).alias("window_key"),
        F.lit(0).alias("dia_start"), n.alias("dia_end"), F.lit(35.0).alias("p_inf"),
        n.alias("target_T")).write.parquet(path))
    return results.read_tau_segments(spark, path)


ERR_SQL = ("err", """
select {by} 'sbp' as metric, sbp_pred - sbp_true as e from {src} union all
select {by} 'dbp', dbp_pred - dbp_true from {src} union all
select {by} 'map', map_pred - map_true from {src}""")


def summary_sql(src, by=()):
    """Error summary over a relation with a column e."""
    keys = "".join(f"{b}, " for b in by)
    group = f" group by {', '.join(by)}" if by else ""
    inner = f"""
select {keys}count(e) as n_beats, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse, avg(e) as bias,
 stddev_pop(e) as std, avg(case when e is null then null when abs(e) <= 5.0 then 1.0 else 0.0 end) * 100 as bhs_within_5,
 avg(case when e is null then null when abs(e) <= 10.0 then 1.0 else 0.0 end) * 100 as bhs_within_10,
 avg(case when e is null then null when abs(e) <= 15.0 then 1.0 else 0.0 end) * 100 as bhs_within_15
from {src}{group}"""
    return f"""
select {keys}n_beats, {rs('mae', 'rmse', 'bias', 'std', 'bhs_within_5', 'bhs_within_10', 'bhs_within_15')},
 {r('bias - 1.96 * std', 'loa_low')}, {r('bias + 1.96 * std', 'loa_high')},
 {r('bias', 'aami_mean_error')}, {r('std', 'aami_std_error')}, abs(bias) <= 5.0 and std <= 8.0 as aami_compliant,
 case when bhs_within_5 is null then null
  when bhs_within_5 >= 60 and bhs_within_10 >= 85 and bhs_within_15 >= 95 then 'A'
  when bhs_within_5 >= 50 and bhs_within_10 >= 75 and bhs_within_15 >= 90 then 'B'
  when bhs_within_5 >= 40 and bhs_within_10 >= 65 and bhs_within_15 >= 85 then 'C' else 'D' end as bhs_grade
from ({inner})"""


def err_sql(src, by=""):
    return ("err", ERR_SQL[1].format(src=src, by=by))


@query("s6_read_metrics_json", with_("scalar_preds", err_sql("scalar_preds"), ("s", summary_sql("err", ["metric"]))) + f"""
select cast(null as double) as waveform_mae,
 max(case when metric = 'sbp' then mae end) as sbp_mae, max(case when metric = 'dbp' then mae end) as dbp_mae,
 max(case when metric = 'map' then mae end) as map_mae, cast(null as double) as absent from s""")
def s6(spark, d):
    path = scratch_path(spark, "metrics")
    s = patients.pooled_scalar_metrics(V.scalar_preds(spark, d))
    one = lambda m: F.max(F.when(F.col("metric") == m, F.round("mae", 8)))
    (s.agg(F.to_json(F.struct(
        F.struct(F.lit("nan").alias("waveform_mae")).alias("waveform"),
        F.struct(*[one(m).alias(f"{m}_mae") for m in fixed.SCALAR_METRICS]).alias("scalar"))
    ).alias("value")).coalesce(1).write.text(path))
    return results.read_metrics_json(spark, path, {
        "waveform_mae": "waveform.waveform_mae", "sbp_mae": "scalar.sbp_mae",
        "dbp_mae": "scalar.dbp_mae", "map_mae": "scalar.map_mae", "absent": "scalar.nothing.here",
    }).drop("metrics_json").where("sbp_mae is not null")


@query("s7_export_method_view", with_("samples", "record_manifest") + """
select cast(row_number() over (order by source_row_index) - 1 as bigint) as export_index,
 'unicardio' as baseline_key, split, source, m.subject_id, m.record_id, hadm_id, fs, num_rows,
 '["PLETH","II"]' as input_columns, 'ABP' as target_column, parquet as source_parquet, 'split=' || split as exported_parquet,
 'records' as source_manifest, source_row_index
from record_manifest m join (select record_id, count(*) as num_rows from samples group by record_id) using (record_id)""")
def s7(spark, d):
    return exported(spark, d).withColumn("exported_parquet", F.element_at(F.split("exported_parquet", "/"), -2))


def exported(spark, d):
    m = V.record_manifest(spark, d)
    rows = records.standardize_records(V.samples(spark, d), m)
    return records.export_method_view(rows, m, "unicardio", scratch_path(spark, "export"))


@query("s7_read_export", with_("samples", "record_manifest") + """
select s.i, s.ecg as "II", s.ppg as "PLETH", s.abp as "ABP", s.fs, s.subject_id, m.hadm_id, s.record_id, m.split, m.source
from samples s join record_manifest m using (record_id) where m.split <> 'val'""")
def s7_read(spark, d):
    return records.read_export(spark, exported(spark, d).where("split <> 'val'"))


@query("s7_read_record", with_("samples", "record_manifest") + """
select s.i, s.ecg as "II", s.ppg as "PLETH", s.abp as "ABP", s.fs, s.subject_id, m.hadm_id, s.record_id, m.split, m.source
from samples s join record_manifest m using (record_id) where s.record_id in (select min(record_id) from samples)""")
def s7_record(spark, d):
    m = V.record_manifest(spark, d)
    path = scratch_path(spark, "export")
    records.export_method_view(records.standardize_records(V.samples(spark, d), m), m, "unicardio", path)
    one = m.orderBy("record_id").first()
    return records.read_record(spark, path, one["split"], one["subject_id"], one["record_id"])


@query("s8_append_table", with_("scalar_preds", err_sql("scalar_preds"), ("s", summary_sql("err", ["metric"]))) + """
select metric, n_beats, mae, bias, bhs_grade from s""")
def s8(spark, d):
    path = scratch_path(spark, "table")
    cols = ["metric", "n_beats", "mae", "bias", "bhs_grade"]
    s = tidy(patients.pooled_scalar_metrics(V.scalar_preds(spark, d)))
    results.append_table(s.where("metric <> 'map'"), path, cols, overwrite=True)
    results.append_table(s.where("metric = 'map'"), path, cols)
    return spark.read.schema("metric string, n_beats bigint, mae double, bias double, "
                             "bhs_grade string").csv(path, header=True)


@query("s10_write_metrics_json", with_("scalar_preds", err_sql("scalar_preds"), ("s", summary_sql("err", ["metric"]))) + """
select metric, n_beats, mae, std, aami_compliant, cast(null as double) as ratio from s""")
def s10(spark, d):
    path = scratch_path(spark, "json")
    s = tidy(patients.pooled_scalar_metrics(V.scalar_preds(spark, d)))
    results.write_metrics_json(s.select("metric", "n_beats", "mae", "std", "aami_compliant",
                                        F.lit(float("nan")).alias("ratio")), path)
    return spark.read.schema("metric string, n_beats bigint, mae double, std double, "
                             "aami_compliant boolean, ratio double").json(path)


# ---------------------------------------------------------------- text and numbers

@query("p1_normalize_token", with_("manifest_src") + f"""
select source_row_index, {CLEAN.format('split')} as split_token, {CLEAN.format('source')} as source_token from manifest_src""")
def p1(spark, d):
    return V.manifest_src(spark, d).select(
        "source_row_index", T.normalize_token("split").alias("split_token"),
        T.normalize_token("source").alias("source_token"))


@query("p2_canonical_split", with_("manifest_src") + f"""
select source_row_index, {split_sql('split')} as split from manifest_src""")
def p2(spark, d):
    return V.manifest_src(spark, d).select("source_row_index",
                                           T.canonical_split("split").alias("split"))


@query("p3_canonical_source", with_("manifest_src") + f"""
select source_row_index, {source_sql('source')} as source from manifest_src""")
def p3(spark, d):
    return V.manifest_src(spark, d).select("source_row_index",
                                           T.canonical_source("source").alias("source"))


@query("p4_resolve_column", with_("manifest_src") + f"""
select source_row_index, {resolve_sql('ii')} as ecg_col, {resolve_sql('pleth', 'ppg')} as ppg_col,
 {resolve_sql('abp', 'art')} as abp_col from manifest_src""")
def p4(spark, d):
    m = V.manifest_src(spark, d).withColumn("columns", F.split("columns_csv", ","))
    return manifests.resolve_signals(m).select("source_row_index", "ecg_col", "ppg_col", "abp_col")


SAFE = "regexp_replace(regexp_replace(trim(cast({} as varchar)), '[^a-zA-Z0-9]', '_', 'g'), '^_+|_+$', '', 'g')"


@query("p5_safe_token", with_("manifest_src") + f"""
select source_row_index, {SAFE.format('source')} as safe_source,
 split || '_' || lpad(cast(source_row_index as varchar), 8, '0') as window_id,
 split || '_' || lpad(cast(source_row_index as varchar), 8, '0') || '_' || {SAFE.format('subject_id')} || '_' || {SAFE.format('record_id')} as case_key
from manifest_src""")
def p5(spark, d):
    return V.manifest_src(spark, d).select(
        "source_row_index", T.safe_token("source").alias("safe_source"),
        T.window_id("split", "source_row_index").alias("window_id"),
        T.case_key("split", "source_row_index", "subject_id", "record_id").alias("case_key"))


@query("p6_first_non_null", with_("manifest_src") + """
select source_row_index, coalesce(fs, file_fs) as first_fs,
 case when source_row_index % 5 = 0 then null else coalesce(fs, 0.0) end as finite_fs from manifest_src""")
def p6(spark, d):
    k = F.col("source_row_index")
    odd = F.when(k % 10 == 0, F.lit(float("nan"))).when(k % 5 == 0, F.lit(float("inf"))).otherwise(
        F.coalesce("fs", F.lit(0.0)))
    nan_first = F.when(k % 2 == 0, F.lit(float("nan")))
    return V.manifest_src(spark, d).select(
        "source_row_index", N.first_non_null(nan_first, "fs", "file_fs").alias("first_fs"),
        N.finite_or_null(odd).alias("finite_fs"))


@query("p7_method_columns", with_("samples", "record_manifest") + """
select s.ecg as "II", s.ppg as "PLETH", s.abp as "ABP", s.fs, s.subject_id, m.hadm_id, s.record_id,
 m.split, m.source from samples s join record_manifest m using (record_id)""")
def p7(spark, d):
    rows = records.standardize_records(V.samples(spark, d), V.record_manifest(spark, d))
    return manifests.method_columns(rows, "ptt_based")


@query("p8_affine", with_("samples") + f"""
select record_id, i, {r('(abp - 100.0) / 50.0', 'scaled')}, {r('((abp - 100.0) / 50.0) * 50.0 + 100.0', 'back')} from samples""")
def p8(spark, d):
    s = V.samples(spark, d).withColumn("scaled", N.standardize("abp", 100.0, 50.0))
    return tidy(s.select("record_id", "i", "scaled", N.affine("scaled", 50.0, 100.0).alias("back")))


CUFF_OK = "case_key % 7 <> 0 and case_key % 11 <> 0"


@query("p9_cuff_features", with_("scalar_preds", ("c", f"""
select *, {CUFF_OK} as ok, cast(case_key % 900 as double) as delta from scalar_preds""")) + f"""
select subject_id, case_key, {r('(case when ok then sbp_true else 0 end - 120) / 40', 'sbp')},
 {r('(case when ok then dbp_true else 0 end - 70) / 25', 'dbp')}, {r('(case when ok then map_true else 0 end - 90) / 30', 'mean')},
 {r('(case when ok then sbp_true - dbp_true else 0 end - 50) / 30', 'pulse')},
 {r('case when ok then delta else 0 end / 600', 'age')}, case when ok then 1.0::double else 0.0::double end as present from c""")
def p9(spark, d):
    p = V.scalar_preds(spark, d)
    delta = F.when(F.col("case_key") % 11 == 0, F.lit(float("nan"))).otherwise(
        (F.col("case_key") % 900).cast("double"))
    f = features.cuff_features("sbp_true", "dbp_true", "map_true", delta, F.col("case_key") % 7 != 0)
    names = ["sbp", "dbp", "mean", "pulse", "age", "present"]
    return tidy(p.withColumn("f", f).select(
        "subject_id", "case_key", *[F.get("f", F.lit(n)).alias(c) for n, c in enumerate(names)]))


@query("p10_window_key", with_("points") + """
select distinct 'subject_id=' || subject_id || '|record_id=' || window_id || '|hadm_id=nan|clean_window_order='
 || (window_id % 10) || '|start=0|end=' || count(*) over (partition by window_id) as window_key from points""")
def p10(spark, d):
    w = V.windows(spark, d)
    return w.select(T.window_key({
        "subject_id": F.col("subject_id"), "record_id": F.col("window_id"),
        "hadm_id": F.lit(None).cast("string"), "clean_window_order": F.col("window_id") % 10,
        "start": F.lit(0), "end": F.size("y_true")}).alias("window_key"))


@query("p11_format_text", with_("scalar_preds", err_sql("scalar_preds", "subject_id, "),
       ("s", """select subject_id, metric, avg(e) as m, stddev_samp(e) as sd, case when metric = 'sbp' then null else max(e) end as hi
 from err group by subject_id, metric""")) + """
select subject_id, metric, case when hi is null or sd is null then '' else printf('%.2f', m / 3) || ' [' || printf('%.2f', (m - sd) / 3) || ', ' || printf('%.2f', (m + sd) / 3) || ']' end as ci,
 case when sd is null then '' else printf('%.3f', m / 3) || ' +/- ' || printf('%.3f', sd / 3) end as mean_sd from s""")
def p11(spark, d):
    long = errors.scalar_errors_long(V.scalar_preds(spark, d), ["subject_id"])
    s = long.groupBy("subject_id", "metric").agg(
        F.avg("error").alias("m"), F.stddev_samp("error").alias("sd"), F.max("error").alias("mx"))
    hidden = F.when(F.col("metric") == "sbp", F.lit(float("nan"))).otherwise(F.col("m") + F.col("sd"))
    return s.select("subject_id", "metric", T.format_ci(F.col("m") / 3, (F.col("m") - F.col("sd")) / 3, hidden / 3, 2).alias("ci"),
                    T.format_mean_sd(F.col("m") / 3, F.col("sd") / 3, 3).alias("mean_sd"))


@query("p12_index_conversion", with_("samples") + f"""
select record_id, i, {r('i / fs', 'sec')}, cast(round_even(i * 5.0 / fs, 0) as bigint) as target_index from samples""")
def p12(spark, d):
    return tidy(V.samples(spark, d).select(
        "record_id", "i", N.index_to_sec("i", "fs").alias("sec"),
        N.scale_index("i", "fs", F.lit(5.0)).alias("target_index")))


# ---------------------------------------------------------------- manifest checks

@query("q1_inspect_manifest", with_("manifest_src", FILES) + """
select count(*) as rows_total, count(case when there then 1 end) as rows_existing_locally,
 count(case when readable and ecg_col is not null and ppg_col is not null and abp_col is not null then 1 end) as rows_qualified,
 count(case when not there then 1 end) as rows_missing_path, count(case when bad then 1 end) as rows_read_error,
 count(case when readable and ecg_col is null then 1 end) as rows_missing_ii, count(case when readable and ppg_col is null then 1 end) as rows_missing_pleth,
 count(case when readable and abp_col is null then 1 end) as rows_missing_abp,
 (select string_agg(f, ',' order by f) from (select distinct printf('%.1f', file_fs) as f from files where readable)) as sample_rates_hz,
 (select string_agg(parquet, ',' order by source_row_index) from (select * from files where readable and ecg_col is not null
   and ppg_col is not null and abp_col is not null order by source_row_index limit 5)) as qualified_examples,
 '' as manifest_missing_columns, true as ready_for_unified_build from files""")
def q1(spark, d):
    out = Q.inspect_manifest(source_manifest(spark, d), file_info(spark, d))
    return out.withColumns({
        "sample_rates_hz": F.array_join(F.transform("sample_rates_hz", lambda f: F.format_string("%.1f", f)), ","),
        "qualified_examples": F.array_join("qualified_examples", ",")})


REASON_SQL = ("case when not there then 'missing_path' when bad then 'read_error' when ecg_col is null then 'missing_ii' "
              "when ppg_col is null then 'missing_pleth' when abp_col is null then 'missing_abp' end")


@query("q2_build_unified_manifest", with_("manifest_src", FILES) + f"""
select {split_sql('split')} as split, {source_sql('source')} as source, cast(subject_id as varchar) as subject_id, record_id,
 cast(null as varchar) as hadm_id, coalesce(fs, file_fs) as fs, parquet, ecg_col, ppg_col, abp_col, 'customers' as source_manifest, source_row_index
from files where {REASON_SQL} is null""")
def q2(spark, d):
    m = source_manifest(spark, d)
    return Q.build_unified_manifest(m, file_info(spark, d), F.col("split"), F.col("source"), "customers")[0]


@query("q2_dropped_reasons", with_("manifest_src", FILES) + f"""
select {REASON_SQL} as reason, count(*) as rows_dropped from files where {REASON_SQL} is not null group by 1""")
def q2b(spark, d):
    m = source_manifest(spark, d)
    return Q.build_unified_manifest(m, file_info(spark, d), "train", "vital", "customers")[1]


PROBLEM_SQL = (f"case when fs is null or parquet is null then 'missing_required_values' when {split_sql('split')} is null then 'invalid_split' "
               f"when {source_sql('source')} is null then 'invalid_source' when not there then 'missing_path' when bad then 'read_error' "
               "when not list_contains(string_split(columns_csv, ','), ecg_col) or not list_contains(string_split(columns_csv, ','), ppg_col) "
               "or not list_contains(string_split(columns_csv, ','), abp_col) then 'signal_column_mismatch' "
               "when abs(fs - file_fs) > 1e-6 + 1e-5 * abs(file_fs) then 'fs_mismatch' end")


@query("q3_validate_manifest", with_("manifest_src", FILES, UNIFIED, ("p", f"select *, {PROBLEM_SQL} as problem from unified"),
       ("k", "select count(*) as n from unified group by split, source, subject_id, record_id, parquet")) + """
select count(*) as rows_total, count(case when problem = 'missing_required_values' then 1 end) as rows_missing_required_values,
 count(case when problem = 'invalid_split' then 1 end) as rows_invalid_split, count(case when problem = 'invalid_source' then 1 end) as rows_invalid_source,
 count(case when problem = 'missing_path' then 1 end) as rows_missing_path, count(case when problem = 'read_error' then 1 end) as rows_read_error,
 count(case when problem = 'signal_column_mismatch' then 1 end) as rows_signal_column_mismatch, count(case when problem = 'fs_mismatch' then 1 end) as rows_fs_mismatch,
 count(case when problem is null then 1 end) as rows_valid, (select cast(sum(n) as bigint) from k where n > 1) as duplicate_key_rows, false as valid from p""")
def q3(spark, d):
    return Q.validate_manifest(unified(spark, d), file_info(spark, d))


EXPORT_SQL = ("ex", """
select case when source_row_index % 97 = 0 then 'other' else 'ppg2abp' end as baseline_key, split, record_id,
 '/x/' || record_id as exported_parquet from manifest_src where split <> 'VALID' union all
select 'ppg2abp', split, record_id, '/x/' || record_id from manifest_src where split <> 'VALID' and source_row_index % 40 = 0""")


@query("q4_check_export_manifest", with_("manifest_src", EXPORT_SQL,
       ("e2", f"select baseline_key, coalesce({split_sql('split')}, split) as split, record_id, exported_parquet from ex"),
       ("k", "select split, count(*) as n from e2 group by split, record_id, exported_parquet")) + """
select count(*) as rows_total, count(case when baseline_key <> 'ppg2abp' then 1 end) as rows_other_method,
 (select cast(sum(n) as bigint) from k where n > 1) as rows_duplicate,
 coalesce((select string_agg(s, ',' order by s) from (values ('train'), ('val'), ('test')) v(s) where s not in (select split from e2)), '') as missing_splits,
 coalesce((select string_agg(s, ',' order by s) from (select distinct split as s from e2 where split not in ('train', 'val', 'test'))), '') as extra_splits,
 false as valid from e2""")
def q4(spark, d):
    m = V.manifest_src(spark, d).where("split <> 'VALID'")
    k = F.col("source_row_index")
    row = lambda key: [key.alias("baseline_key"),
                       F.coalesce(T.canonical_split("split"), "split").alias("split"), "source",
                       "subject_id", "record_id", F.lit(None).cast("string").alias("hadm_id"), "fs",
                       F.concat(F.lit("/x/"), "record_id").alias("exported_parquet"),
                       F.lit("m").alias("source_manifest"), "source_row_index"]
    e = m.select(*row(F.when(k % 97 == 0, "other").otherwise("ppg2abp")))
    e = e.unionByName(m.where(k % 40 == 0).select(*row(F.lit("ppg2abp"))))
    return Q.check_export_manifest(e, "ppg2abp", strict=True)


# ---------------------------------------------------------------- reference quality

QC_SQL = ("qc", """
select subject_id, window_id, bad, not bad and lo < 62.0 as low, not bad and hi > 150.0 as high, not bad and sd < 20.0 as flat,
 not bad and hi - lo < 70.0 as tiny, not bad and hi - lo > 95.0 as huge from (
 select subject_id, window_id, count(y_true) < count(*) as bad, min(y_true) as lo, max(y_true) as hi, stddev_pop(y_true) as sd
 from points group by subject_id, window_id)""")
QC_ARGS = {"min_abp": 62.0, "max_abp": 150.0, "min_std": 20.0, "min_range": 70.0, "max_range": 95.0}


@query("q5_waveform_qc", with_("points", QC_SQL) + """
select subject_id, window_id, bad as qc_nonfinite, low as qc_below_min_abp, high as qc_above_max_abp, flat as qc_below_min_std,
 tiny as qc_below_min_range, huge as qc_above_max_range, not (bad or low or high or flat or tiny or huge) as qc_valid from qc""")
def q5(spark, d):
    return Q.waveform_qc(V.windows(spark, d), **QC_ARGS).drop("y_true", "y_pred")


@query("q5_waveform_qc_report", with_("points", QC_SQL, ("per", """
select subject_id, count(*) as n, count(case when not (bad or low or high or flat or tiny or huge) then 1 end) as v, count(case when bad then 1 end) as a, count(case when low then 1 end) as b,
 count(case when high then 1 end) as c, count(case when flat then 1 end) as d, count(case when tiny then 1 end) as e, count(case when huge then 1 end) as f from qc group by subject_id""")) + f"""
select cast(sum(n) as bigint) as n_windows_total, cast(sum(v) as bigint) as n_windows_valid, cast(sum(a) as bigint) as nonfinite,
 cast(sum(b) as bigint) as below_min_abp, cast(sum(c) as bigint) as above_max_abp, cast(sum(d) as bigint) as below_min_std,
 cast(sum(e) as bigint) as below_min_range, cast(sum(f) as bigint) as above_max_range, count(*) as n_patients_total,
 count(case when v > 0 then 1 end) as n_patients_with_valid_windows, min(v) as valid_windows_min, max(v) as valid_windows_max,
 cast(sum(n) - sum(v) as bigint) as n_windows_excluded, {r('sum(v) / sum(n)', 'valid_fraction')},
 cast(quantile_cont(v, 0.5) as double) as valid_windows_median from per""")
def q5b(spark, d):
    return tidy(Q.waveform_qc_report(Q.waveform_qc(V.windows(spark, d), **QC_ARGS)))


@query("q6_scalar_qc", with_("scalar_preds", ("f", """
select sbp_true is null or dbp_true is null or map_true is null as a, dbp_true < 65.0 or map_true < 65.0 as b,
 sbp_true > 145.0 or map_true > 145.0 as c, sbp_true - dbp_true < 45.0 as d, sbp_true - dbp_true > 68.0 as e from scalar_preds""")) + f"""
select count(*) as n_scalar_total, count(case when not (a or b or c or d or e) then 1 end) as n_scalar_valid, count(case when a or b or c or d or e then 1 end) as n_scalar_excluded,
 {r('count(case when not (a or b or c or d or e) then 1 end) / count(*)', 'valid_fraction')}, count(case when a then 1 end) as nonfinite, count(case when b then 1 end) as below_min_abp,
 count(case when c then 1 end) as above_max_abp, count(case when d then 1 end) as below_min_range, count(case when e then 1 end) as above_max_range from f""")
def q6(spark, d):
    flagged = Q.scalar_qc(V.scalar_preds(spark, d), min_abp=65.0, max_abp=145.0, min_range=45.0,
                          max_range=68.0)
    return tidy(Q.scalar_qc_report(flagged))


# ---------------------------------------------------------------- windows bookkeeping

WIN_SQL = ("win", """
select split, subject_id, record_id, k as window_index, count(*) as n, count(case when ppg is null or abp is null then 1 end) as n_bad from (
 select *, unnest(range(greatest(0, cast(ceil((i - 15) / 8.0) as bigint)), cast(floor(i / 8.0) as bigint) + 1)) as k from samples)
group by split, subject_id, record_id, k having count(*) = 16""")


def sample_windows(spark, d, keep_all=False, cols=("ppg", "abp")):
    return fixed_windows(V.samples(spark, d), 4.0, 2.0, list(cols), keep_all=keep_all)


@query("q7_zero_window_records", with_("samples", "record_manifest", WIN_SQL) + """
select split, record_id, source, 'no finite window' as reason from record_manifest m
where not exists (select 1 from win w where w.n_bad = 0 and w.record_id = m.record_id and w.split = m.split)""")
def q7(spark, d):
    m = V.record_manifest(spark, d).select("split", "record_id", "source")
    return alignment.zero_window_records(m, sample_windows(spark, d)).select(
        "split", "record_id", "source", "reason")


@query("q8_reconcile", with_("points", ("w", "select window_id, window_id % 3 as split, count(*) as n from points group by window_id"),
       ("p", "select split, window_id, n as t, case when window_id % 13 = 0 then n - 1 else n end as y from w where window_id % 10 <> 0"),
       ("m", "select split, window_id from w where window_id % 7 <> 0")) + """
select split, count(case when p.window_id is not null and m.window_id is not null then 1 end) as matched, count(case when m.window_id is null then 1 end) as only_predictions,
 count(case when p.window_id is null then 1 end) as only_metadata, count(case when p.window_id is not null and t <> y then 1 end) as unequal_length
from p full outer join m using (split, window_id) group by split""")
def q8(spark, d):
    w = V.windows(spark, d).withColumn("split", F.col("window_id") % 3)
    cut = F.when(F.col("window_id") % 13 == 0,
                 F.slice("y_pred", F.lit(1), F.size("y_pred") - 1)).otherwise(F.col("y_pred"))
    p = w.where(F.col("window_id") % 10 != 0).withColumn("y_pred", cut)
    return alignment.reconcile(p, w.where(F.col("window_id") % 7 != 0))


@query("q9_window_funnel", with_(("own_ids", V.SQL["samples"]), ("samples", V.SHARED_IDS_SQL), WIN_SQL, ("per", """
select split, subject_id, record_id, count(*) as c, count(case when n_bad = 0 and window_index % 5 <> 0 then 1 end) as k, count(case when n_bad > 0 then 1 end) as b,
 count(case when n_bad = 0 and window_index % 5 = 0 then 1 end) as v from win group by split, subject_id, record_id"""),
       ("listed", "select distinct split, subject_id, record_id from samples")) + """
select split, count(*) as records, cast(coalesce(sum(c), 0) as bigint) as candidate_windows, cast(coalesce(sum(k), 0) as bigint) as kept_windows,
 cast(coalesce(sum(b), 0) as bigint) as dropped_nonfinite_windows, cast(coalesce(sum(v), 0) as bigint) as dropped_low_variance_windows
from listed left join per using (split, subject_id, record_id) group by split""")
def q9(spark, d):
    s = V.shared_ids(V.samples(spark, d))
    made = fixed_windows(s, 4.0, 2.0, ["ppg", "abp"], keep_all=True)
    return window_funnel(made, F.col("window_index") % 5 == 0, s)


# ---------------------------------------------------------------- splits

@query("d1_group_split", with_("manifest_src", ("g", """
select subject_id, row_number() over (order by md5('2025|' || subject_id), subject_id) as pos, count(*) over () as n
from (select distinct subject_id from manifest_src where subject_id is not null)""")) + """
select source_row_index, m.subject_id, case when pos <= least(greatest(1, cast(round_even(n * 0.2, 0) as bigint)), n - 1) then 'val' else 'train' end as split
from manifest_src m left join g using (subject_id)""")
def d1(spark, d):
    m = V.manifest_src(spark, d).select("source_row_index", "subject_id")
    return D.group_split(m, "subject_id", 0.2, 2025).select("source_row_index", "subject_id", "split")


@query("d2_kfold", with_("case_embeddings") + """
select case_key, cast(ntile(4) over (order by case_key) - 1 as int) as fold from case_embeddings""")
def d2(spark, d):
    c = V.case_embeddings(spark, d).select("case_key")
    return D.kfold(c, 4, ["case_key"], [F.floor(F.col("case_key") / 4096)])


@query("d3_union_manifests", with_("manifest_src") + """
select 'train' as origin, source_row_index, record_id, source from manifest_src where split = 'Training' union all
select 'val', source_row_index, record_id, null from manifest_src where split in ('VALID', 'Validation')""")
def d3(spark, d):
    m = V.manifest_src(spark, d)
    return D.union_manifests({
        "train": m.where("split = 'Training'").select("source_row_index", "record_id", "source"),
        "val": m.where("split in ('VALID', 'Validation')").select("source_row_index", "record_id"),
    }).select("origin", "source_row_index", "record_id", "source")


INDEXED = ("indexed", """
select split, subject_id, record_id, window_index, cast(row_number() over (partition by split order by subject_id, record_id, window_index) - 1 as bigint) as memmap_index
from win where n_bad = 0""")
SHARED = [("own_ids", V.SQL["samples"]), ("samples", V.SHARED_IDS_SQL)]


def indexed_windows(spark, d):
    made = fixed_windows(V.shared_ids(V.samples(spark, d)), 4.0, 2.0, ["ppg", "abp"])
    return assign_index(made, ["subject_id", "record_id", "window_index"])


@query("d4_slice_windows", with_(*SHARED, WIN_SQL, INDEXED) + """
select subject_id, record_id, window_index, memmap_index from indexed where split = 'test' and memmap_index >= (select count(*) from indexed where split = 'test') // 4
 and memmap_index < (select count(*) // 4 + greatest(1, count(*) // 2) from indexed where split = 'test')""")
def d4(spark, d):
    test = indexed_windows(spark, d).where("split = 'test'")
    n = test.count()
    return slice_windows(test, "memmap_index", n // 4, max(1, n // 2)).select(
        "subject_id", "record_id", "window_index", "memmap_index")


@query("d5_assign_index", with_(*SHARED, WIN_SQL, INDEXED) + """
select split, subject_id, record_id, window_index, memmap_index, split || '_' || lpad(cast(memmap_index as varchar), 8, '0') as window_id from indexed""")
def d5(spark, d):
    return indexed_windows(spark, d).select("split", "subject_id", "record_id", "window_index", "memmap_index", "window_id")


@query("s11_write_windows", with_("samples", WIN_SQL) + f"""
select w.split, w.record_id, w.window_index, {r('sum(s.ppg)', 'ppg_sum')}, {r('sum(s.abp * (s.i - 8 * w.window_index))', 'abp_moment')}
from win w join samples s on s.record_id = w.record_id and s.i >= 8 * w.window_index and s.i < 8 * w.window_index + 16
where w.n_bad = 0 group by w.split, w.record_id, w.window_index""")
def s11(spark, d):
    path = scratch_path(spark, "windows")
    records.write_windows(sample_windows(spark, d), path)
    w = spark.read.parquet(path)
    moment = F.aggregate(F.transform("abp", lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return tidy(w.select("split", "record_id", "window_index", F.aggregate(
        "ppg", F.lit(0.0), lambda s, x: s + x).alias("ppg_sum"), moment.alias("abp_moment")))
