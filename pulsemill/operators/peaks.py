"""Peaks and beats.

`peak_rules` holds the small numeric helpers; Spark cuts the data into bounded arrays (whole
windows, or blocks of a long segment) and calls them per array.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsemill.functions.arrays import array_mean, bind
from pulsemill.functions.numeric import is_finite
from pulsemill.operators import blocks
from pulsemill.operators.peak_rules import find_peaks


def detect_peaks(values, window_seconds: float, min_distance_sec: float = 0.30,
                 prominence_scale: float = 0.10) -> Column:
    """Peak positions of one window as an ARRAY<BIGINT>; empty when the window is unusable.

    Windows below 8 samples or with a missing sample have no peaks. The distance is
    max(1, round(0.30 * fs)) with fs = n / window_seconds, the prominence
    max(1e-6, 0.10 * population deviation).
    """
    @F.pandas_udf("array<bigint>")
    def peaks_of(arrays: pd.Series) -> pd.Series:
        out = []
        for a in arrays:
            x = np.asarray([] if a is None else a, dtype=np.float64)
            if x.size < 8 or not np.isfinite(x).all():
                out.append([])
                continue
            apart = max(1, int(round(min_distance_sec * x.size / window_seconds)))
            found, _ = find_peaks(x, apart, max(1e-6, float(x.std()) * prominence_scale))
            out.append(found)
        return pd.Series(out, dtype=object)

    return peaks_of(F.col(values) if isinstance(values, str) else values)


def beat_segments(peaks, n) -> Column:
    """Half-open beats around each peak, cut midway to the neighbours.

    Beats shorter than 3 samples or not holding their peak are dropped.
    """
    size = F.col(n) if isinstance(n, str) else n

    def cut(p):
        def one(peak, k):
            start = F.when(k == 0, F.lit(0)).otherwise(
                F.floor((F.get(p, k - F.lit(1)) + peak) / F.lit(2)))
            end = F.when(k == F.size(p) - F.lit(1), size).otherwise(
                F.floor((peak + F.get(p, k + F.lit(1))) / F.lit(2)))
            return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"),
                            peak.cast("bigint").alias("peak"))
        return F.transform(p, one)

    return F.filter(bind(peaks, cut), lambda s: (s["end"] - s["start"] >= 3)
                    & (s["peak"] >= s["start"]) & (s["peak"] < s["end"]))


def beat_stats(values, segments) -> Column:
    """Per beat: value at the given peak, minimum, mean. Beats with a gap are dropped."""
    segs = F.col(segments) if isinstance(segments, str) else segments

    def measure(x):
        def one(s):
            beat = F.slice(x, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
            return bind(beat, lambda b: F.struct(
                F.get(x, s["peak"].cast("int")).alias("sbp"), F.array_min(b).alias("dbp"),
                array_mean(b).alias("map"), s["peak"].alias("peak"),
                F.forall(b, lambda v: is_finite(v)).alias("ok")))
        return F.transform(segs, one)

    return F.filter(bind(values, measure), lambda b: b["ok"])


def pulse_triplets(windows: DataFrame, values: str, peaks: str, keys: list) -> DataFrame:
    """Inner pulses with the trough before and after, from at least 3 distinct peaks."""
    x, p = F.col(values), F.col("__p")
    rows = windows.withColumn("__p", F.array_sort(F.array_distinct(F.filter(
        peaks, lambda v: (v >= 0) & (v < F.size(x)))))).where(
            (F.size("__p") >= 3) & (F.size(x) >= 8) & F.forall(x, lambda v: is_finite(v)))

    def trough(a, b):
        part = F.slice(x, (a + 1).cast("int"), (b - a).cast("int"))
        return a + F.array_position(part, F.array_min(part)) - 1

    def one(k):
        before, peak, after = F.get(p, k - F.lit(1)), F.get(p, k), F.get(p, k + F.lit(1))
        return F.struct(
            peak.alias("peak"), trough(before, peak).alias("trough_before"),
            trough(peak, after).alias("trough_after"),
            ((peak - before >= 3) & (after - peak >= 3)).alias("wide"))

    inner = F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(1)), one)
    at = lambda c: F.get(x, F.col(f"__t.{c}").cast("int"))
    out = rows.select(*keys, values, F.explode(inner).alias("__t")).withColumn(
        "pulse_pressure", at("peak") - F.least(at("trough_before"), at("trough_after")))
    return (out.where(F.col("__t.wide") & (F.col("__t.trough_before") < F.col("__t.peak"))
                      & (F.col("__t.peak") < F.col("__t.trough_after"))
                      & (F.col("pulse_pressure") > 0))
            .select(*keys, F.col("__t.peak").alias("peak"),
                    F.col("__t.trough_before").alias("trough_before"),
                    F.col("__t.trough_after").alias("trough_after"), "pulse_pressure"))


def segment_peaks(samples: DataFrame, segments: DataFrame, channels: dict,
                  min_distance_sec: float, keys=("record_id",), block: int = blocks.BLOCK) -> DataFrame:
    """Peaks of z-scored signals in segments of any length; one row per (kind, peak).

    `channels`: kind -> (column, prominence, invert). All channels share one pass over the
    samples, which are packed into blocks; see `blocks` for what crosses them. Flat segments
    have no peaks.
    """
    cols = sorted({channels[k][0] for k in channels})
    packed = blocks.pack_blocks(samples, cols, keys, block)
    pieces = blocks.pieces_of(packed, segments, cols, keys, block)
    return blocks.block_peaks(packed, pieces, channels, min_distance_sec, keys, block)
