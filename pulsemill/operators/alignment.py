"""Bringing predictions, metadata, labels and segments together."""

from pyspark.sql import DataFrame, functions as F

from pulsemill.functions.numeric import is_finite


def attach_subjects(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """Add subject (and record, source) from case labels; the case key stands in when absent.

    Predictions that already carry a subject are returned unchanged.
    """
    if "subject_id" in preds.columns:
        return preds
    cols = [c for c in ("subject_id", "record_id", "source") if c in labels.columns]
    joined = preds.join(labels.select("case_key", *cols), "case_key", "left")
    return joined.withColumn("subject_id", F.coalesce(
        F.col("subject_id").cast("string"), F.col("case_key").cast("string")))


def reconcile(preds: DataFrame, windows: DataFrame, key=("split", "window_id"),
              true="y_true", pred="y_pred") -> DataFrame:
    """Per split: windows on both sides, only on one side, and with unequal lengths."""
    key = list(key)
    left = preds.select(*key, F.size(true).alias("__t"), F.size(pred).alias("__p"))
    right = windows.select(*key, F.lit(1).alias("__w"))
    both = left.join(right, key, "full_outer")
    have_p, have_w = F.col("__t").isNotNull(), F.col("__w").isNotNull()
    return both.groupBy(key[0]).agg(
        F.count_if(have_p & have_w).alias("matched"), F.count_if(~have_w).alias("only_predictions"),
        F.count_if(~have_p).alias("only_metadata"),
        F.count_if(have_p & (F.col("__t") != F.col("__p"))).alias("unequal_length"))


def attach_metadata(preds: DataFrame, windows: DataFrame, key: str = "memmap_index",
                    split: str = "test", check: bool = True) -> DataFrame:
    """Predictions of one split with their window metadata, matched by index.

    With `check`, counts that differ raise an error before anything is joined.
    """
    meta = windows.where(F.col("split") == split)
    if check:
        n_preds, n_meta = preds.count(), meta.count()
        if n_preds != n_meta:
            raise ValueError(f"{n_preds} predictions but {n_meta} metadata rows")
    return preds.join(meta, key)


def zero_window_records(records: DataFrame, windows: DataFrame, strict: bool = False,
                        keys=("split", "record_id")) -> DataFrame:
    """Records that yield no window, with the reason; `strict` raises when there is one."""
    out = records.join(windows.select(*keys).distinct(), list(keys), "left_anti").withColumn(
        "reason", F.lit("no finite window"))
    if strict and not out.isEmpty():
        raise ValueError("some records yield no window")
    return out


def join_tau_segments(windows: DataFrame, segments: DataFrame, mask: str = "mask") -> DataFrame:
    """Decay segments of each window that lie fully inside the valid mask.

    `target_T` must equal the mask length of the window; a difference raises an error.
    """
    part = F.slice(mask, (F.col("dia_start") + 1).cast("int"),
                   (F.col("dia_end") - F.col("dia_start")).cast("int"))
    agree = F.col("target_T") == F.size(mask)
    checked = F.when(agree, F.col("target_T")).otherwise(
        F.raise_error(F.lit("target_T differs from the window length")).cast("int"))
    return (windows.join(segments, "window_key")
            .withColumn("target_T", checked)
            .where((F.col("dia_end") <= F.size(mask)) & F.forall(part, lambda m: m)))


def align_targets(embeddings: DataFrame, labels: DataFrame, key: str = "case_key") -> DataFrame:
    return embeddings.join(labels, key)


def check_tau_segments(segments: DataFrame) -> DataFrame:
    """Rows that break the segment contract."""
    return segments.where((F.col("dia_end") <= F.col("dia_start")) | (F.col("target_T") <= 0)
                          | ~is_finite("p_inf"))
