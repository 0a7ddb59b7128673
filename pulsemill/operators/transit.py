"""Pulse transit: R peaks, pulse feet, pairing, calibration."""

from pyspark.sql import DataFrame, functions as F

from pulsemill.functions import fixed
from pulsemill.functions.numeric import is_finite, round_even
from pulsemill.operators.indexing import dense_index, with_next
from pulsemill.operators import blocks
from pulsemill.operators.peaks import segment_peaks
from pulsemill.operators.windows import BLOCK
from pulsemill.sources.storage import materialize, stored


def _of_kind(peaks: DataFrame, kind: str, name: str) -> DataFrame:
    return peaks.where(F.col("kind") == kind).drop("kind").withColumnRenamed("peak", name)


def ecg_r_peaks(samples, segments, ecg="ecg", prominence=fixed.ECG_PROMINENCE,
                min_distance_sec=fixed.MIN_PEAK_DISTANCE_SEC, keys=("record_id",)) -> DataFrame:
    """R peaks: peaks of the z-scored ecg."""
    found = segment_peaks(samples, segments, {"r": (ecg, prominence, False)}, min_distance_sec, keys)
    return _of_kind(found, "r", "r")


def ppg_feet(samples, segments, ppg="ppg", prominence=fixed.PPG_PROMINENCE,
             min_distance_sec=fixed.MIN_PEAK_DISTANCE_SEC, keys=("record_id",)) -> DataFrame:
    """Pulse feet: peaks of the negated z-scored pulse."""
    found = segment_peaks(samples, segments, {"foot": (ppg, prominence, True)}, min_distance_sec, keys)
    return _of_kind(found, "foot", "foot")


def label_r_peaks(r_peaks: DataFrame, feet: DataFrame, min_ptt_sec=fixed.MIN_PTT_SEC,
                  max_ptt_sec=fixed.MAX_PTT_SEC, keys=("record_id",)) -> DataFrame:
    """Every R peak with its foot, the foot after that, and why it was dropped.

    The foot is the first one in [R + round(min * fs), R + round(max * fs)]. Segments
    with fewer than two feet count every R peak as without a foot. The range join runs
    as an equi-join: an R peak looks only at the few time bins its range can touch.
    """
    keys = list(keys)
    seg = keys + ["seg_start"]
    width = F.greatest(round_even(F.col("fs") * max_ptt_sec), F.lit(1))
    feet = with_next(feet.select(*seg, "fs", "foot"), seg, "foot",
                     F.floor(F.col("foot") / F.lit(BLOCK)), "next_foot", "__first")
    alone = F.col("__first") & F.col("next_foot").isNull()
    binned = feet.where(~alone).select(*seg, "foot", "next_foot",
                                       F.floor(F.col("foot") / width).alias("__bin"))
    lo = F.col("r") + round_even(F.col("fs") * min_ptt_sec)
    hi = F.col("r") + round_even(F.col("fs") * max_ptt_sec)
    rows = r_peaks.withColumns({"__lo": lo, "__hi": hi}).withColumn(
        "__bin", F.explode(F.sequence(F.floor(F.col("__lo") / width),
                                      F.floor(F.col("__hi") / width), F.lit(1))))
    near = (rows.join(binned, seg + ["__bin"])
            .where((F.col("foot") >= F.col("__lo")) & (F.col("foot") <= F.col("__hi")))
            .groupBy(*seg, "r").agg(F.min(F.struct("foot", "next_foot")).alias("__f"))
            .select(*seg, "r", F.col("__f.foot").alias("foot"),
                    F.col("__f.next_foot").alias("next_foot")))
    return r_peaks.join(near, seg + ["r"], "left").withColumn(
        "drop_reason",
        F.when(F.col("foot").isNull(), "no_ppg_foot")
        .when(F.col("next_foot").isNull(), "no_next_ppg_foot"))


def pair_ptt(labelled: DataFrame, packed: DataFrame, abp="abp", keys=("record_id",),
             block: int = blocks.BLOCK) -> DataFrame:
    """Beats: pressure over [foot, next foot) as max, min, mean, and the transit time.

    `packed` holds the pressure in blocks (`blocks.pack_blocks`)."""
    keys = list(keys)
    beats = labelled.where(F.col("drop_reason").isNull())
    spans = beats.select(*keys, F.col("foot").alias("start"), F.col("next_foot").alias("stop")).distinct()
    values = blocks.span_values(packed, spans, abp, keys, block).select(
        *keys, F.col("start").alias("foot"), F.col("highest").alias("sbp_true"),
        F.col("lowest").alias("dbp_true"), F.col("mean").alias("map_true"))
    return (beats.join(values, keys + ["foot"])
            .withColumn("ptt_sec", (F.col("foot") - F.col("r")) / F.col("fs"))
            .drop("drop_reason"))


def extract_beats(samples: DataFrame, min_segment_sec=fixed.MIN_FINITE_SEGMENT_SEC,
                  min_ptt_sec=fixed.MIN_PTT_SEC, max_ptt_sec=fixed.MAX_PTT_SEC,
                  min_distance_sec=fixed.MIN_PEAK_DISTANCE_SEC,
                  ecg_prominence=fixed.ECG_PROMINENCE, ppg_prominence=fixed.PPG_PROMINENCE,
                  keys=("record_id",), block: int = blocks.BLOCK):
    """(beats, labelled R peaks, feet, segments) of every record.

    Samples are shuffled once, to be packed; all steps read the packed blocks."""
    keys, cols = list(keys), ["ecg", "ppg", "abp"]
    if not 0 < min_ptt_sec < max_ptt_sec:
        raise ValueError("need 0 < min_ptt_sec < max_ptt_sec")
    need = round_even(F.col("fs") * min_segment_sec)
    packed = stored(blocks.pack_blocks(samples, cols, keys, block), "packed")
    pieces = materialize(blocks.finite_pieces(packed, cols, keys, need, block))
    found = materialize(blocks.block_peaks(packed, pieces, {"r": ("ecg", ecg_prominence, False),
                                                            "foot": ("ppg", ppg_prominence, True)},
                                           min_distance_sec, keys, block))
    r, feet = _of_kind(found, "r", "r"), _of_kind(found, "foot", "foot")
    labelled = label_r_peaks(r, feet, min_ptt_sec, max_ptt_sec, keys)
    return pair_ptt(labelled, packed, "abp", keys, block), labelled, feet, blocks.segments_of(pieces, keys)


def number_beats(beats: DataFrame, keys=("record_id",)) -> DataFrame:
    """Beat position inside its record."""
    return dense_index(beats, list(keys), ["r"], [F.floor(F.col("r") / F.lit(BLOCK))],
                       "beat_index_in_record")


def extraction_report(records: DataFrame, beats, labelled, feet, segments,
                      keys=("record_id",)) -> DataFrame:
    """One row of counters over all records."""
    keys = list(keys)
    one = [
        records.select(*keys).distinct().agg(F.count(F.lit(1)).alias("records")),
        beats.select(*keys).distinct().agg(F.count(F.lit(1)).alias("records_with_beats")),
        segments.agg(F.count(F.lit(1)).alias("finite_segments")),
        feet.agg(F.count(F.lit(1)).alias("ppg_feet")),
        labelled.agg(
            F.count(F.lit(1)).alias("r_peaks"), F.count(F.lit(1)).alias("candidate_r_peaks"),
            F.count_if(F.col("drop_reason").isNull()).alias("paired_beats"),
            F.count_if(F.col("drop_reason") == "no_ppg_foot").alias("dropped_no_ppg_foot"),
            F.count_if(F.col("drop_reason") == "no_next_ppg_foot")
            .alias("dropped_no_next_ppg_foot"),
            F.lit(0).cast("bigint").alias("dropped_empty_abp_interval")),
    ]
    out = one[0]
    for part in one[1:]:
        names = part.columns
        value = part.select(F.struct(*names)).scalar()
        out = out.withColumn("__s", value).select(
            *out.columns, *[F.col(f"__s.{n}").alias(n) for n in names])
    return out


def ptt_feature(ptt, transform: str = "inverse_ptt"):
    x = F.col(ptt) if isinstance(ptt, str) else ptt
    ok = is_finite(x) & (x > 0)
    if transform == "inverse_ptt":
        return F.when(ok, F.lit(1.0) / x)
    if transform == "log_ptt":
        return F.when(ok, F.ln(x))
    raise ValueError(f"unknown transform {transform!r}")


def fit_ptt(beats: DataFrame, transform: str = "inverse_ptt") -> DataFrame:
    """One row: per target intercept, slope and residual sum of squares.

    `rank_deficient` is true when the feature does not vary.
    """
    f = ptt_feature("ptt_sec", transform)
    rows = beats.withColumn("__f", f)
    # Finite-difference sums around the mean come from the engine's own regression aggregates.
    aggs = [F.count("__f").alias("n_fit_beats"), F.avg("__f").alias("feature_mean"),
            F.stddev_pop("__f").alias("feature_std")]
    for m in fixed.SCALAR_METRICS:
        y = F.col(f"{m}_true")
        slope = F.regr_slope(y, "__f")
        rss = F.regr_syy(y, "__f") - slope * F.regr_sxy(y, "__f")
        aggs += [F.regr_intercept(y, "__f").alias(f"{m}_intercept"), slope.alias(f"{m}_slope"),
                 F.greatest(rss, F.lit(0.0)).alias(f"{m}_rss")]
    aggs.append((F.coalesce(F.regr_sxx(F.col("sbp_true"), F.col("__f")), F.lit(0.0)) <= 0)
                .alias("rank_deficient"))
    return rows.agg(*aggs)


def predict_ptt(beats: DataFrame, model: DataFrame, transform: str = "inverse_ptt") -> DataFrame:
    """Add predicted pressures; the one-row model is read as a scalar subquery."""
    f = ptt_feature("ptt_sec", transform)
    rows = beats.withColumn("__k", model.select(F.struct("*")).scalar()).withColumn("__f", f)
    return rows.withColumns({
        f"{m}_pred": F.col(f"__k.{m}_intercept") + F.col(f"__k.{m}_slope") * F.col("__f")
        for m in fixed.SCALAR_METRICS}).drop("__k", "__f")
