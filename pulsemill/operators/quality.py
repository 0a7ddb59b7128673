"""Manifest checks and reference quality control."""

from pyspark.sql import DataFrame, functions as F

from pulsemill.functions import fixed
from pulsemill.functions.arrays import all_finite, array_var_pop
from pulsemill.functions.numeric import close_to, first_non_null, is_finite
from pulsemill.functions.text import canonical_source, canonical_split
from pulsemill.operators.quantiles import exact_quantiles


def with_file_info(manifest: DataFrame, file_info: DataFrame) -> DataFrame:
    """Attach what was read from each file: file_exists, read_error, columns, ecg_col,
    ppg_col, abp_col, file_fs. A path without information counts as missing."""
    # Rows without a path get a key of their own, so that they do not meet in one task.
    key = F.coalesce(F.col("parquet"), F.concat(F.lit("no path "), "source_row_index"))
    info = file_info.withColumnRenamed("parquet", "__path")
    return (manifest.withColumn("__path", key).join(info, "__path", "left").drop("__path")
            .withColumn("file_exists", F.coalesce("file_exists", F.lit(False))))


def _reason():
    """First failing reason of a source manifest row."""
    return (F.when(F.col("parquet").isNull() | ~F.col("file_exists"), "missing_path")
            .when(F.col("read_error").isNotNull(), "read_error")
            .when(F.col("ecg_col").isNull(), "missing_ii")
            .when(F.col("ppg_col").isNull(), "missing_pleth")
            .when(F.col("abp_col").isNull(), "missing_abp"))


def missing_columns(df: DataFrame, required: list) -> list:
    return [c for c in required if c not in df.columns]


def inspect_manifest(manifest: DataFrame, file_info: DataFrame) -> DataFrame:
    """One row: totals, existing, qualified, and what is missing (reasons may overlap).

    Lists the distinct sampling rates (6 decimals) and the first five qualified files.
    """
    rows = with_file_info(manifest, file_info)
    there = F.col("parquet").isNotNull() & F.col("file_exists")
    read = there & F.col("read_error").isNull()
    good = read & F.col("ecg_col").isNotNull() & F.col("ppg_col").isNotNull() \
        & F.col("abp_col").isNotNull()
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(there).alias("rows_existing_locally"),
        F.count_if(good).alias("rows_qualified"), F.count_if(~there).alias("rows_missing_path"),
        F.count_if(there & ~read).alias("rows_read_error"),
        F.count_if(read & F.col("ecg_col").isNull()).alias("rows_missing_ii"),
        F.count_if(read & F.col("ppg_col").isNull()).alias("rows_missing_pleth"),
        F.count_if(read & F.col("abp_col").isNull()).alias("rows_missing_abp"))
    # Recordings use a handful of rates, so the distinct set is small by nature.
    rates = (rows.where(read & is_finite("file_fs")).select(F.round("file_fs", 6).alias("f"))
             .distinct().agg(F.sort_array(F.collect_list("f")).alias("r")))
    firsts = (rows.where(good).orderBy("source_row_index").limit(5)
              .agg(F.sort_array(F.collect_list(F.struct("source_row_index", "parquet")))
                   .alias("e")).select(F.col("e.parquet").alias("e")))
    missing = missing_columns(manifest, fixed.SOURCE_MANIFEST_REQUIRED)
    return counts.withColumns({
        "sample_rates_hz": rates.scalar(), "qualified_examples": firsts.scalar(),
        "manifest_missing_columns": F.lit(",".join(missing)),
        "ready_for_unified_build": F.lit(not missing)})


def build_unified_manifest(manifest: DataFrame, file_info: DataFrame, split, source,
                           source_manifest: str) -> tuple:
    """(kept rows in unified column order, dropped counts by first failing reason)."""
    missing = missing_columns(manifest, fixed.SOURCE_MANIFEST_REQUIRED)
    if missing:
        raise ValueError(f"source manifest lacks columns: {missing}")
    split = F.lit(split) if isinstance(split, str) else split
    source = F.lit(source) if isinstance(source, str) else source
    rows = with_file_info(manifest, file_info).withColumn("__reason", _reason())
    stem = F.regexp_extract("parquet", r"([^/]+?)(\.[^./]*)?$", 1)
    hadm = F.col("hadm_id") if "hadm_id" in manifest.columns else F.lit(None).cast("string")
    built = rows.where(F.col("__reason").isNull()).select(
        canonical_split(split).alias("split"), canonical_source(source).alias("source"),
        F.col("subject_id").cast("string").alias("subject_id"),
        F.coalesce(F.col("record_id").cast("string"), stem).alias("record_id"),
        hadm.cast("string").alias("hadm_id"), first_non_null("fs", "file_fs").alias("fs"),
        "parquet", "ecg_col", "ppg_col", "abp_col",
        F.lit(source_manifest).alias("source_manifest"), "source_row_index")
    dropped = (rows.where(F.col("__reason").isNotNull()).groupBy(F.col("__reason").alias("reason"))
               .agg(F.count(F.lit(1)).alias("rows_dropped")))
    return built, dropped


def classify_manifest(df: DataFrame, file_info: DataFrame) -> DataFrame:
    """Each unified row with its first failing class in `problem` (NULL when valid)."""
    rows = with_file_info(df, file_info.select("parquet", "file_exists", "read_error", "columns",
                                               "file_fs"))
    absent = F.lit(False)
    for c in fixed.UNIFIED_MANIFEST_COLUMNS:
        if c not in fixed.UNIFIED_MANIFEST_NULLABLE:
            absent = absent | F.col(c).isNull()
    named = F.array("ecg_col", "ppg_col", "abp_col")
    fs_known = is_finite("file_fs")
    return rows.withColumn(
        "problem",
        F.when(absent, "missing_required_values")
        .when(canonical_split("split").isNull(), "invalid_split")
        .when(canonical_source("source").isNull(), "invalid_source")
        .when(~F.col("file_exists"), "missing_path")
        .when(F.col("read_error").isNotNull(), "read_error")
        .when(F.size(F.array_except(named, "columns")) > 0, "signal_column_mismatch")
        .when(fs_known & ~close_to("fs", "file_fs", 1e-6, 1e-5), "fs_mismatch"))


def validate_manifest(df: DataFrame, file_info: DataFrame) -> DataFrame:
    """One row: counts per failing class, duplicate key rows (all members), verdict."""
    missing = missing_columns(df, fixed.UNIFIED_MANIFEST_COLUMNS)
    if missing:
        raise ValueError(f"unified manifest lacks columns: {missing}")
    rows = classify_manifest(df, file_info)
    classes = ["missing_required_values", "invalid_split", "invalid_source", "missing_path",
               "read_error", "signal_column_mismatch", "fs_mismatch"]
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows_total"),
        *[F.count_if(F.col("problem") == c).alias(f"rows_{c}") for c in classes],
        F.count_if(F.col("problem").isNull()).alias("rows_valid"))
    key = ["split", "source", "subject_id", "record_id", "parquet"]
    doubles = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint").alias("d"))
    return counts.withColumn("duplicate_key_rows", doubles.scalar()).withColumn(
        "valid", (F.col("rows_total") > 0) & (F.col("rows_valid") == F.col("rows_total"))
        & (F.col("duplicate_key_rows") == 0))


def check_export_manifest(df: DataFrame, method: str, strict: bool = False) -> DataFrame:
    """One-row verdict on an export manifest: method key, duplicates, split coverage.

    `strict` also rejects split labels other than train, val and test.
    """
    missing = missing_columns(df, fixed.EXPORT_MANIFEST_REQUIRED)
    if missing:
        raise ValueError(f"export manifest lacks columns: {missing}")
    expected = F.array(*[F.lit(s) for s in fixed.SPLITS])
    keys = df.groupBy("split", "record_id", "exported_parquet").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("baseline_key") != method).alias("other"))
    per_split = keys.groupBy("split").agg(
        F.sum("n").alias("n"), F.sum("other").alias("other"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("dup"))
    # Split labels are few; one row per label meets here.
    out = per_split.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_total"),
        F.coalesce(F.sum("other"), F.lit(0)).alias("rows_other_method"),
        F.coalesce(F.sum("dup"), F.lit(0)).alias("rows_duplicate"),
        F.collect_set("split").alias("__present"))
    listed = lambda a: F.array_join(F.array_sort(a), ",")
    out = out.withColumns({
        "missing_splits": listed(F.array_except(expected, "__present")),
        "extra_splits": listed(F.array_except("__present", expected))})
    ok = ((F.col("rows_other_method") == 0) & (F.col("rows_duplicate") == 0)
          & (F.col("missing_splits") == ""))
    if strict:
        ok = ok & (F.col("extra_splits") == "")
    return out.drop("__present").withColumn("valid", ok)


def waveform_qc(windows: DataFrame, col: str = "y_true", min_abp=fixed.QC_MIN_ABP,
                max_abp=fixed.QC_MAX_ABP, min_std=fixed.QC_MIN_STD,
                min_range=fixed.QC_MIN_RANGE, max_range=fixed.QC_MAX_RANGE) -> DataFrame:
    """Flag each window by its reference array only; reasons may overlap.

    Comparisons are made only on fully finite windows.
    """
    _check_thresholds(min_abp, max_abp, min_std, min_range, max_range)
    out = windows.withColumn("__ok", all_finite(col))
    finite = F.col("__ok")
    measured = out.withColumns({
        "__lo": F.when(finite, F.array_min(col)), "__hi": F.when(finite, F.array_max(col)),
        "__sd": F.when(finite, F.sqrt(array_var_pop(col)))})
    lo, hi, sd = F.col("__lo"), F.col("__hi"), F.col("__sd")
    is_true = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "qc_nonfinite": ~finite,
        "qc_below_min_abp": is_true(lo < min_abp), "qc_above_max_abp": is_true(hi > max_abp),
        "qc_below_min_std": is_true(sd < min_std),
        "qc_below_min_range": is_true(hi - lo < min_range),
        "qc_above_max_range": is_true(hi - lo > max_range)}
    out = measured.withColumns(flags)
    bad = F.lit(False)
    for f in flags:
        bad = bad | F.col(f)
    return out.withColumn("qc_valid", ~bad).drop("__ok", "__lo", "__hi", "__sd")


def _check_thresholds(min_abp, max_abp, min_std, min_range, max_range):
    if min_abp >= max_abp or min_std < 0 or min_range < 0 or max_range <= 0 \
            or min_range >= max_range:
        raise ValueError("inconsistent quality thresholds")


def waveform_qc_report(flagged: DataFrame, by: str = "subject_id") -> DataFrame:
    """One row: window counts, reasons, and valid windows per patient (min, median, max)."""
    reasons = ["nonfinite", "below_min_abp", "above_max_abp", "below_min_std",
               "below_min_range", "above_max_range"]
    per = flagged.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("qc_valid").alias("v"),
        *[F.count_if(f"qc_{r}").alias(r) for r in reasons])
    median = exact_quantiles(per, [], "v", {"median": 0.5})
    out = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_windows_total"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("n_windows_valid"),
        *[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in reasons],
        F.count(F.lit(1)).alias("n_patients_total"),
        F.count_if(F.col("v") > 0).alias("n_patients_with_valid_windows"),
        F.coalesce(F.min("v"), F.lit(0)).alias("valid_windows_min"),
        F.coalesce(F.max("v"), F.lit(0)).alias("valid_windows_max"))
    return out.withColumns({
        "n_windows_excluded": F.col("n_windows_total") - F.col("n_windows_valid"),
        "valid_fraction": F.try_divide("n_windows_valid", "n_windows_total"),
        "valid_windows_median": F.coalesce(median.scalar(), F.lit(0.0))})


def scalar_qc(preds: DataFrame, min_abp=fixed.QC_MIN_ABP, max_abp=fixed.QC_MAX_ABP,
              min_range=fixed.QC_MIN_RANGE, max_range=fixed.QC_MAX_RANGE) -> DataFrame:
    """Flag scalar truths: finite, pressures in bounds, pulse pressure in bounds."""
    s, d, m = (F.when(is_finite(f"{k}_true"), F.col(f"{k}_true")) for k in ("sbp", "dbp", "map"))
    is_true = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "qc_nonfinite": s.isNull() | d.isNull() | m.isNull(),
        "qc_below_min_abp": is_true(d < min_abp) | is_true(m < min_abp),
        "qc_above_max_abp": is_true(s > max_abp) | is_true(m > max_abp),
        "qc_below_min_range": is_true(s - d < min_range),
        "qc_above_max_range": is_true(s - d > max_range)}
    out = preds.withColumns(flags)
    bad = F.lit(False)
    for f in flags:
        bad = bad | F.col(f)
    return out.withColumn("qc_valid", ~bad)


def scalar_qc_report(flagged: DataFrame) -> DataFrame:
    reasons = ["nonfinite", "below_min_abp", "above_max_abp", "below_min_range",
               "above_max_range"]
    return flagged.agg(
        F.count(F.lit(1)).alias("n_scalar_total"), F.count_if("qc_valid").alias("n_scalar_valid"),
        F.count_if(~F.col("qc_valid")).alias("n_scalar_excluded"),
        F.try_divide(F.count_if("qc_valid"), F.count(F.lit(1))).alias("valid_fraction"),
        *[F.count_if(f"qc_{r}").alias(r) for r in reasons])
