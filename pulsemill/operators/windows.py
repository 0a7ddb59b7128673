"""Cutting recordings: finite runs, fixed windows, positions, window bookkeeping.

A recording is a long table with one row per sample: key columns, `i` (position),
`fs` (samples per second) and one column per channel.
"""

from pyspark.sql import DataFrame, Window, functions as F

from pulsemill.functions.arrays import bind
from pulsemill.functions.numeric import index_to_sec, is_finite, round_even
from pulsemill.functions.text import window_id
from pulsemill.operators.indexing import range_index

BLOCK = 65536
WINDOW_BLOCK = 8192


def finite_segments(samples: DataFrame, cols: list, min_length, keys=("record_id",),
                    block: int = BLOCK) -> DataFrame:
    """Maximal runs [seg_start, seg_end) in which every channel is finite.

    Runs are found per (record, block). Only pieces that touch a block edge, at most two
    per block, are stitched across the record.
    `min_length` is a number of samples or a column computed from `fs`.
    """
    keys = list(keys)
    good = F.lit(True)
    for c in cols:
        good = good & is_finite(c)
    need = F.lit(min_length) if isinstance(min_length, (int, float)) else min_length
    rows = (samples.where(good)
            .select(*keys, "i", need.alias("__need"),
                    F.floor(F.col("i") / F.lit(block)).alias("__blk")))
    inside = Window.partitionBy(*keys, "__blk").orderBy("i")
    pieces = (rows.withColumn("__run", F.col("i") - F.row_number().over(inside))
              .groupBy(*keys, "__blk", "__run")
              .agg(F.min("i").alias("__s"), (F.max("i") + 1).alias("__e"),
                   F.max("__need").alias("__need")))
    edge = ((F.col("__s") == F.col("__blk") * block)
            | (F.col("__e") == (F.col("__blk") + 1) * block))
    whole = pieces.where(~edge).select(*keys, "__s", "__e", "__need")

    along = Window.partitionBy(*keys).orderBy("__s")
    touching = (pieces.where(edge)
                .withColumn("__new", F.when(F.lag("__e").over(along) == F.col("__s"), 0)
                            .otherwise(1))
                .withColumn("__grp", F.sum("__new").over(
                    along.rowsBetween(Window.unboundedPreceding, 0)))
                .groupBy(*keys, "__grp")
                .agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"),
                     F.max("__need").alias("__need"))
                .drop("__grp"))
    return (whole.unionByName(touching)
            .where(F.col("__e") - F.col("__s") >= F.greatest(F.col("__need"), F.lit(1)))
            .select(*keys, F.col("__s").alias("seg_start"), F.col("__e").alias("seg_end")))


def tag_segments(samples: DataFrame, segments: DataFrame, keys=("record_id",),
                 block: int = BLOCK) -> DataFrame:
    """Samples inside segments, with the segment's columns attached.

    Segments of a record must not overlap. Each segment puts a marker at its start and at
    the start of every further block it covers. Per (record, block), each sample then takes
    the last marker at or before it, so the work is linear however short the segments are.
    """
    keys = list(keys)
    own = [c for c in segments.columns if c not in keys]
    size = F.lit(block)
    markers = (segments.withColumn("__blk", F.explode(F.sequence(
        F.floor(F.col("seg_start") / size), F.floor((F.col("seg_end") - 1) / size), F.lit(1))))
        .select(*keys, "__blk", F.greatest("seg_start", F.col("__blk") * size).alias("__at"),
                F.lit(0).alias("__order"), F.struct(*own).alias("__seg")))
    rest = [c for c in samples.columns if c not in keys]
    rows = samples.select(*keys, F.floor(F.col("i") / size).alias("__blk"),
                          F.col("i").alias("__at"), F.lit(1).alias("__order"),
                          F.struct(*rest).alias("__row"))
    w = (Window.partitionBy(*keys, "__blk").orderBy("__at", "__order")
         .rowsBetween(Window.unboundedPreceding, 0))
    both = rows.unionByName(markers, allowMissingColumns=True)
    return (both.withColumn("__in", F.last("__seg", ignorenulls=True).over(w))
            .where(F.col("__row").isNotNull() & (F.col("__at") < F.col("__in.seg_end")))
            .select(*keys, *[F.col("__row").getField(c).alias(c) for c in rest],
                    *[F.col("__in").getField(c).alias(c) for c in own]))


def attach_to_segments(rows: DataFrame, facts: DataFrame, keys=("record_id",),
                       block: int = BLOCK, hint: str = None) -> DataFrame:
    """Add per-segment facts to rows that already know their `seg_start`.

    The facts are listed once per block of the segment, so that a long segment is joined in
    many places. `hint` is a join hint for the facts.
    """
    on = [*keys, "seg_start", "__blk"]
    listed = facts.withColumn("__blk", F.explode(F.sequence(
        F.floor(F.col("seg_start") / F.lit(block)),
        F.floor((F.col("seg_end") - 1) / F.lit(block)), F.lit(1)))).drop("seg_end")
    if hint:
        listed = listed.hint(hint)
    if "__blk" in rows.columns:
        return rows.join(listed, on)
    return rows.withColumn("__blk", F.floor(F.col("i") / F.lit(block))).join(listed, on).drop("__blk")


def fixed_windows(samples: DataFrame, window_sec: float, step_sec: float, cols: list,
                  keys=("split", "subject_id", "record_id"), keep_all: bool = False) -> DataFrame:
    """Fixed windows of each record as one row with an ARRAY per channel.

    Starts are 0, S, 2S, ... with S = round(fs * step) and length L = round(fs * window).
    Samples are shuffled once, into blocks of consecutive starts; only those at the head of a
    block are also sent to the block before, whose last windows reach into it. Windows are cut from the
    blocks' arrays, and a long record spreads over many tasks. Incomplete windows are
    dropped. Windows with a missing or non-finite sample in `cols` are dropped unless
    `keep_all` is set; `n_bad` counts such samples.
    """
    keys = list(keys)
    length, step = round_even(F.col("fs") * window_sec), round_even(F.col("fs") * step_sec)
    bad = F.lit(False)
    for c in cols:
        bad = bad | ~is_finite(c)
    L, S, i = F.col("__L"), F.col("__S"), F.col("i")
    per = F.greatest(F.ceil(L / S), F.ceil(F.lit(WINDOW_BLOCK) / S), F.lit(1)).cast("bigint")
    blk = F.floor(i / (F.col("__m") * S))
    reached = (i - blk * F.col("__m") * S < L - S) & (blk > 0)
    rows = (samples.where(F.col("fs").isNotNull()).withColumns({"__L": length, "__S": step}).withColumn("__m", per)
            .select(*keys, "fs", "i", *cols, "__L", "__S", "__m", bad.alias("__bad"),
                    F.explode(F.when(reached, F.array(blk, blk - 1)).otherwise(F.array(blk))).alias("__blk")))
    # Collecting before the shuffle would not shrink anything, so rows are placed first.
    made = rows.repartition(*keys, "__blk").groupBy(*keys, "__blk").agg(
        F.max("__L").alias("__L"), F.max("__S").alias("__S"), F.max("__m").alias("__m"), F.max("fs").alias("fs"),
        F.sort_array(F.collect_list(F.struct("i", "__bad", *cols))).alias("__d"))

    def cut(d):
        first, n = F.get(d, F.lit(0))["i"], F.size(d)
        whole = F.get(d, n - 1)["i"] - first + 1 == n

        def at(k):
            start = k * S
            place = F.when(whole, start - first).otherwise(F.array_position(d["i"], start) - 1)
            return F.struct(k.alias("k"), place.cast("int").alias("at"))

        def fits(w):
            last = F.get(d, (w["at"] + L - 1).cast("int"))["i"]
            return (w["at"] >= 0) & (last == w["k"] * S + L - 1)

        def window(w):
            part = F.slice(d, w["at"] + 1, L.cast("int"))
            return bind(part, lambda x: F.struct(
                w["k"].alias("window_index"),
                F.size(F.filter(x["__bad"], lambda v: v)).cast("bigint").alias("n_bad"), *[x[c].alias(c) for c in cols]))

        numbers = F.sequence(F.col("__blk") * F.col("__m"), (F.col("__blk") + 1) * F.col("__m") - 1)
        return F.transform(F.filter(F.transform(numbers, at), fits), window)

    made = made.select(*keys, "fs", "__L", "__S", F.explode(bind(F.col("__d"), cut)).alias("__w")).select(
        *keys, "fs", "__L", "__S", "__w.*")
    if not keep_all:
        made = made.where(F.col("n_bad") == 0)
    start = F.col("window_index") * S
    return made.select(
        *keys, "window_index", "fs", "n_bad",
        F.lit(float(window_sec)).alias("window_sec"), F.lit(float(step_sec)).alias("step_sec"),
        start.alias("source_start_index"), (start + L).alias("source_end_index"),
        index_to_sec(start, "fs").alias("source_start_sec"),
        index_to_sec(start + L, "fs").alias("source_end_sec"), *cols)


def window_funnel(candidates: DataFrame, low_variance=None, records: DataFrame = None,
                  keys=("split", "subject_id", "record_id")) -> DataFrame:
    """Per split: records, candidates, kept, dropped by reason.

    `candidates` come from `fixed_windows(..., keep_all=True)`; `low_variance` is an
    optional condition that drops finite windows. `records` (`keys`; samples will
    do) is the list of all records, so that those too short for a window count as well. A
    record is told by all `keys`: two subjects may use the same record id.
    """
    keys = list(keys)
    flat = F.lit(False) if low_variance is None else low_variance
    finite = F.col("n_bad") == 0
    per_record = candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("c"), F.count_if(finite & ~flat).alias("k"),
        F.count_if(~finite).alias("b"), F.count_if(finite & flat).alias("v"))
    if records is not None:
        listed = records.select(*keys).distinct()
        per_record = listed.join(per_record, keys, "left").fillna(0, ["c", "k", "b", "v"])
    return per_record.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"), F.sum("c").alias("candidate_windows"),
        F.sum("k").alias("kept_windows"), F.sum("b").alias("dropped_nonfinite_windows"),
        F.sum("v").alias("dropped_low_variance_windows"))


def assign_index(windows: DataFrame, order: list, name: str = "memmap_index") -> DataFrame:
    """Dense 0-based index per split plus the printable window id."""
    return range_index(windows, ["split"], order, name).withColumn("window_id", window_id("split", name))


def slice_windows(windows: DataFrame, index: str, start: int = 0, limit: int = None) -> DataFrame:
    """Contiguous part [start, start + limit) of an indexed table, bounds checked."""
    if start < 0:
        raise ValueError("start must be non-negative")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    last = windows.agg(F.max(index)).first()[0]
    available = 0 if last is None else last + 1
    if start >= available:
        raise ValueError(f"start={start} is past the {available} available windows")
    if limit is None:
        return windows.where(F.col(index) >= start)
    if start + limit > available:
        raise ValueError(f"[{start}, {start + limit}) is past the {available} available windows")
    return windows.where((F.col(index) >= start) & (F.col(index) < start + limit))


def apply_mask(df: DataFrame, mask: str, cols: list) -> DataFrame:
    """Masked-out values become missing."""
    return df.withColumns({c: F.when(F.col(mask), F.col(c)) for c in cols})
