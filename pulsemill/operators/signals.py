"""Transforms along a segment: normalising, derivatives, smoothing, resampling.

Segments can be as long as a recording. Every transform here either reduces a segment to
one row of statistics, or looks at a fixed neighbourhood and therefore runs per
(segment, block) with a halo.
"""

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from pulsemill.functions.arrays import all_finite, bind
from pulsemill.functions.numeric import round_even
from pulsemill.operators import filters
from pulsemill.operators.indexing import with_halo
from pulsemill.operators.windows import BLOCK, attach_to_segments, fixed_windows

SEG = ("record_id", "seg_start")


def zscore(tagged: DataFrame, col: str, out: str, flat: str = "zero", keys=SEG,
           block: int = BLOCK) -> DataFrame:
    """Z-score per segment with the population deviation.

    Segments with deviation <= 1e-12 become zeros (`flat="zero"`) or vanish
    (`flat="drop"`). Statistics are aggregated, then met again on (segment, block).
    """
    if flat not in ("zero", "drop"):
        raise ValueError("flat must be 'zero' or 'drop'")
    keys = list(keys)
    stats = tagged.groupBy(*keys, "seg_end").agg(
        F.avg(col).alias("__m"), F.stddev_pop(col).alias("__sd"))
    if flat == "drop":
        stats = stats.where(F.col("__sd") > 1e-12)
    names = [k for k in keys if k != "seg_start"]
    rows = attach_to_segments(tagged, stats, names, block)
    z = F.when(F.col("__sd") > 1e-12, (F.col(col) - F.col("__m")) / F.col("__sd")).otherwise(0.0)
    return rows.withColumn(out, z).drop("__m", "__sd")


def derivatives(tagged: DataFrame, col: str, names=("vpg", "apg", "jpg"), keys=SEG,
                block: int = BLOCK) -> DataFrame:
    """Chain of gradients: centred differences, one-sided at the segment ends."""
    keys, n = list(keys), len(names)
    rows = with_halo(tagged, "i", block, n, "__blk", "__core")
    w = Window.partitionBy(*keys, "__blk").orderBy("i")
    source = col
    for name in names:
        prev, nxt, here = F.lag(source).over(w), F.lead(source).over(w), F.col(source)
        rows = rows.withColumn(
            name,
            F.when(F.col("i") == F.col("seg_start"), nxt - here)
            .when(F.col("i") == F.col("seg_end") - 1, here - prev)
            .otherwise((nxt - prev) / 2.0))
        source = name
    return rows.where("__core").drop("__blk", "__core")


def smooth_zero_phase(tagged: DataFrame, col: str, out: str, width: int, keys=SEG,
                      block: int = BLOCK) -> DataFrame:
    """Boxcar of `width` run forward and backward over the odd-extended segment.

    Both passes have finite reach, so each sample needs `2 * (width - 1)` neighbours.
    Segments must be longer than the extension (3 * width); shorter ones are dropped.
    """
    if width < 1:
        raise ValueError("width must be at least 1")
    keys, reach = list(keys), 2 * (width - 1)
    rows = tagged.where(F.col("seg_end") - F.col("seg_start") > 3 * width)
    if width == 1:
        return rows.withColumn(out, F.col(col))
    ends = rows.groupBy(*keys, "seg_end").agg(
        F.max(F.when(F.col("i") == F.col("seg_start"), F.col(col))).alias("__x0"),
        F.max(F.when(F.col("i") == F.col("seg_end") - 1, F.col(col))).alias("__x1"))
    names = [k for k in keys if k != "seg_start"]
    rows = attach_to_segments(rows, ends, names, block)
    i, s, e, x = F.col("i"), F.col("seg_start"), F.col("seg_end"), F.col(col)
    # Mirrored rows exist only for the sums; the original columns travel with the real row.
    kept = F.struct(*[c for c in rows.columns if c not in ("__x0", "__x1")])
    none = F.lit(None).cast(rows.select(kept).schema[0].dataType)
    part = lambda at, value, row: F.struct(at.alias("i"), value.alias("x"), row.alias("row"))
    left = F.when((i > s) & (i - s <= reach), part(s * 2 - i, F.col("__x0") * 2 - x, none))
    right = F.when((i < e - 1) & (e - 1 - i <= reach),
                   part((e - 1) * 2 - i, F.col("__x1") * 2 - x, none))
    extended = rows.select(*keys, F.explode(F.array_compact(
        F.array(part(i, x, kept), left, right))).alias("__p"))
    extended = extended.select(*keys, F.col("__p.i").alias("__i"), F.col("__p.x").alias("__x"),
                               F.col("__p.row").alias("__row"))
    halo = with_halo(extended, "__i", block, reach, "__blk", "__core")
    w = Window.partitionBy(*keys, "__blk").orderBy("__i")
    done = (halo.withColumn("__f", F.avg("__x").over(w.rowsBetween(-(width - 1), 0)))
            .withColumn(out, F.avg("__f").over(w.rowsBetween(0, width - 1)))
            .where(F.col("__core") & F.col("__row").isNotNull()))
    return done.select("__row.*", out)


def smoothing_width(fs: float, milliseconds: float) -> int:
    return round(fs * milliseconds / 1000)


def rational_rates(fs_in: float, fs_out: float) -> tuple:
    """Reduced (up, down) with up / down = fs_out / fs_in."""
    ratio = Fraction(float(fs_out)).limit_denominator() / Fraction(float(fs_in)).limit_denominator()
    return ratio.numerator, ratio.denominator


def polyphase_taps(up: int, down: int) -> list:
    """Low-pass taps: Kaiser (beta 5) windowed sinc, unit gain at zero, scaled by `up`."""
    top = max(up, down)
    half = 10 * top
    m = np.arange(-half, half + 1)
    taps = np.sinc(m / top) / top * np.kaiser(2 * half + 1, 5.0)
    return [float(t) for t in taps / taps.sum() * up]


MOST_RATES = 10_000


def _rates(rows: DataFrame, fs: str) -> list:
    """The different sampling rates of a table: one per kind of recorder, whatever the data's size."""
    found = [r[0] for r in rows.select(fs).distinct().limit(MOST_RATES + 1).collect() if r[0] is not None]
    if len(found) > MOST_RATES:
        raise ValueError(f"more than {MOST_RATES} different sampling rates")
    return sorted(map(float, found))


def _tap_tables(spark, rates: list, fs_out: float) -> DataFrame:
    """(fs, up, down, half, taps), one row per rate; rates of one reduced pair share their taps."""
    made, rows = {}, []
    for fs in rates:
        up, down = rational_rates(fs, fs_out)
        if (up, down) not in made:
            made[up, down] = [1.0] if up == down else polyphase_taps(up, down)
        rows.append((fs, up, down, len(made[up, down]) // 2, made[up, down]))
    return spark.createDataFrame(rows, "__fs double, __up bigint, __down bigint, __half bigint, __taps array<double>")


def resample_polyphase(tagged: DataFrame, cols: list, fs_in: float, fs_out: float,
                       keys=SEG, block: int = BLOCK) -> DataFrame:
    """Rational-rate resampling of each segment; output position `m` from 0.

    `fs_in` is the rate of all rows, or None for that of each segment's own `fs`. out[m] = sum over k of
    x[k] * taps[half + m * down - k * up], for m < ceil(n * up / down), with the taps of the segment's
    rate. The input is held as one array per (segment, block) with a halo, and every output
    sample is produced by the block that owns it.
    """
    return _resampled(tagged, cols, fs_in, fs_out, keys, block).drop("__fs")


def _resampled(tagged, cols, fs_in, fs_out, keys, block):
    keys = list(keys)
    rate = F.col("fs").cast("double") if fs_in is None else F.lit(float(fs_in))
    tagged = tagged.withColumn("__fs", rate)
    rates = _rates(tagged, "__fs") if fs_in is None else [float(fs_in)]
    tables = _tap_tables(tagged.sparkSession, rates, fs_out)
    reach = max([h // u + 1 for u, h in tables.select("__up", "__half").collect()], default=0)
    local = tagged.where(F.col("seg_end") - F.col("seg_start") >= 2).withColumn(
        "__k", F.col("i") - F.col("seg_start"))
    rows = with_halo(local, "__k", block, reach, "__blk", "__core")
    packed = rows.repartition(*keys, "__blk").groupBy(*keys, "seg_end", "__fs", "__blk").agg(
        F.sort_array(F.collect_list(F.struct("__k", *cols))).alias("__d"))
    packed = packed.join(F.broadcast(tables), "__fs")  # at most MOST_RATES rows
    up, down, half = F.col("__up"), F.col("__down"), F.col("__half")
    n = F.col("seg_end") - F.col("seg_start")
    size = F.ceil(n * up / down)
    first = F.ceil(F.col("__blk") * F.lit(block) * up / down)
    stop = F.least(size, F.ceil((F.col("__blk") + 1) * F.lit(block) * up / down))
    packed = packed.withColumns({
        "__m0": F.greatest(first, F.lit(0)).cast("bigint"), "__m1": stop.cast("bigint")})
    packed = packed.where(F.col("__m1") > F.col("__m0"))
    grid = F.sequence("__m0", F.col("__m1") - 1, F.lit(1))

    def filtered(x, k0):
        last = k0 + F.size(x) - F.lit(1)

        def at(m):
            lo = F.greatest(F.ceil((m * down - half) / up), k0)
            hi = F.least(F.floor((m * down + half) / up), last)
            near = F.when(hi >= lo, F.sequence(lo, hi, F.lit(1))).otherwise(
                F.array().cast("array<bigint>"))
            return F.aggregate(near, F.lit(0.0), lambda s, k: s + F.get(x, (k - k0).cast("int"))
                               * F.get(F.col("__taps"), (m * down - k * up + half).cast("int")))
        return F.transform(grid, at)

    def column(c):
        first_k = F.get(F.col("__d").getField("__k"), F.lit(0))
        return bind(F.col("__d").getField(c), lambda x: bind(first_k, lambda k0: filtered(x, k0)))

    zipped = packed.select(*keys, "seg_end", "__fs", F.arrays_zip(
        grid.alias("m"), *[column(c).alias(c) for c in cols]).alias("__z"))
    return zipped.select(*keys, "seg_end", "__fs", F.explode("__z").alias("__o")).select(
        *keys, "seg_end", "__fs", F.col("__o.m").alias("m"), *[F.col(f"__o.{c}").alias(c) for c in cols])


def labelled_segments(tagged: DataFrame, ppg: str, abp: str, fs_in: float, fs_out: float,
                      length: int, step: int, keys=SEG, block: int = BLOCK,
                      smooth_ms: float = 50.0, band=filters.BAND, smooth_from: float = 75.0) -> DataFrame:
    """Fixed segments on the target grid with pressure labels.

    `fs_in` is the rate of all rows, or None for that of each record's own `fs`. Per source segment:
    z-score the pulse, band-pass it (`band`; None: not), smooth it when fs >= `smooth_from`, resample pulse and
    pressure, then cut `length` samples every `step`. Labels are max, min and mean of
    the pressure; positions are mapped back to the source. Segments too short for a filter's mirrored
    ends, or of a rate too low for the band, give nothing.
    """
    keys = list(keys)
    z = zscore(tagged, ppg, "__z", flat="drop", keys=keys, block=block).withColumn("__p", F.col(abp).cast("double"))
    if fs_in is not None:
        z = z.withColumn("fs", F.lit(float(fs_in)))
    if band is not None:
        z = filters.band_pass(z, "__z", "__zb", keys, band, others=["__p"]).withColumnRenamed("__zb", "__z")
    z = z.select(*keys, "seg_end", "i", "fs", "__z", "__p")
    rates = [float(fs_in)] if fs_in is not None else _rates(tagged, "fs")
    widths = {}
    for fs in rates:
        if fs >= smooth_from:
            widths.setdefault(smoothing_width(fs, smooth_ms), []).append(fs)
    if widths:
        plain = z.where(F.col("fs") < smooth_from)
        for width, own in widths.items():
            smooth = smooth_zero_phase(z.where(F.col("fs").isin(own)), "__z", "__zs", width, keys, block)
            plain = plain.unionByName(smooth.drop("__z").withColumnRenamed("__zs", "__z"))
        z = plain
    target = _resampled(z, ["__z", "__p"], None, fs_out, keys, block)
    ready = target.withColumnsRenamed({"m": "i"}).withColumn("fs", F.lit(1.0))
    cut = fixed_windows(ready, float(length), float(step), ["__z", "__p"], keys + ["seg_end", "__fs"])
    source = F.col("__fs")
    back = lambda c: F.col("seg_start") + round_even(F.col(c) * source / F.lit(fs_out))
    return cut.select(
        *keys, "seg_end", F.col("source_start_index").alias("target_start_index"),
        F.col("source_end_index").alias("target_end_index"),
        (back("source_start_index") / source).alias("target_start_sec"),
        (back("source_end_index") / source).alias("target_end_sec"),
        F.col("__z").alias("ppg"), F.col("__p").alias("abp"),
        F.array_max("__p").alias("sbp"), F.array_min("__p").alias("dbp"),
        (F.aggregate("__p", F.lit(0.0), lambda s, x: s + x) / F.size("__p")).alias("map"),
    ).where(all_finite("ppg") & all_finite("abp"))


def case_labels(segments: DataFrame, keys: list) -> DataFrame:
    """Mean labels per case; NULL keys form their own group."""
    return segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_segments"), F.avg("sbp").alias("sbp"),
        F.avg("dbp").alias("dbp"), F.avg("map").alias("map"))


def fit_minmax(windows: DataFrame, cols: list, splits=("train", "val")) -> DataFrame:
    """One row with the smallest and largest value of each array column over the fit splits."""
    fit = windows.where(F.col("split").isin(*splits))
    aggs = []
    for c in cols:
        aggs += [F.min(F.array_min(c)).alias(f"min_{c}"), F.max(F.array_max(c)).alias(f"max_{c}")]
    return fit.agg(*aggs)


def apply_minmax(windows: DataFrame, constants: DataFrame, cols: list) -> DataFrame:
    """Scale array columns by the fitted constants (read once, as a scalar subquery)."""
    k = constants.select(F.struct("*")).scalar()
    df = windows.withColumn("__k", k)

    def scaled(c):
        lo, hi = F.col("__k").getField(f"min_{c}"), F.col("__k").getField(f"max_{c}")
        span = F.when(hi > lo, hi - lo).otherwise(
            F.raise_error(F.lit("normalization span must be positive")).cast("double"))
        return F.transform(c, lambda v: (v - lo) / span)

    return df.withColumns({c: scaled(c) for c in cols}).drop("__k")
