"""Running metrics and event-time windows on streams."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pulsemill.functions import fixed
from pulsemill.operators.errors import waveform_metrics
from pulsemill.functions.numeric import is_finite


def running_waveform_metrics(stream: DataFrame, by: list) -> DataFrame:
    """Metrics so far per group; state is a handful of sums per group (complete mode)."""
    return waveform_metrics(stream, by)


def event_windows_qc(stream: DataFrame, time: str, value: str, by: list, length: str,
                     slide: str = None, delay: str = "10 minutes",
                     min_abp=fixed.QC_MIN_ABP, max_abp=fixed.QC_MAX_ABP) -> DataFrame:
    """Event-time windows with range statistics and a quality flag (append mode).

    Rows later than `delay` are dropped by the watermark; windows align to the epoch.
    """
    x = F.when(is_finite(value), F.col(value))
    cut = F.window(time, length, slide) if slide else F.window(time, length)
    out = (stream.withWatermark(time, delay).groupBy(*by, cut.alias("w"))
           .agg(F.count(F.lit(1)).alias("n"), F.count(x).alias("n_finite"),
                F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean")))
    ok = (F.col("n") == F.col("n_finite")) & (F.col("lo") >= min_abp) & (F.col("hi") <= max_abp)
    return out.select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "n", "n_finite", "lo", "hi", "mean", F.coalesce(ok, F.lit(False)).alias("valid"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is available now into a Parquet table and stop."""
    q = (stream.writeStream.outputMode(mode).format("parquet")
         .option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def drain_complete(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is available now; the table at `path` holds the latest complete result."""
    def save(batch, _):
        batch.write.mode("overwrite").parquet(path)
    q = (stream.writeStream.outputMode("complete").foreachBatch(save)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


_OPEN = StructType([StructField("i", ArrayType(LongType())), StructField("at", ArrayType(LongType())),
                    StructField("values", ArrayType(DoubleType())), StructField("done", ArrayType(LongType())),
                    StructField("frontier", LongType())])


def record_windows(stream: DataFrame, time: str, window_sec: float, step_sec: float, cols: list, keys: list,
                   delay: str = "10 minutes") -> DataFrame:
    """The windows of `windows.fixed_windows` from a stream of samples, each given out once, as soon as
    all its samples are there (append mode).

    Windows start at 0, S, 2S, ... of the record's own position `i`, not of the clock. Samples may come in any
    order within `delay` of the event time `time`; later ones are dropped. Per record the state holds the samples that
    a window still waits for. A window with a sample missing is given up once the watermark has passed
    a sample beyond it; a record without news is forgotten when the watermark passes its last one.
    Every sample of a record carries the same `fs`.
    """
    width = len(cols)
    kept = stream.select(*keys, "i", F.col("fs").cast("double").alias("fs"), time,
                         F.unix_millis(F.col(time)).alias("__ms"), *[F.col(c).cast("double").alias(c) for c in cols])
    out = StructType([kept.schema[k] for k in keys] + [StructField("window_index", LongType())]
                     + [StructField(c, ArrayType(DoubleType())) for c in cols])

    def advance(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        held, fs = {}, None
        done, frontier = set(), 0
        if state.exists:
            pos, at, values, past, frontier = state.get
            done = set(past)
            for k, (i, t) in enumerate(zip(pos, at)):
                held[i] = (t, values[k * width:(k + 1) * width])
        for pdf in batches:
            fs = float(pdf["fs"].iloc[0])
            for i, t, *v in zip(pdf["i"], pdf["__ms"], *[pdf[c] for c in cols]):
                held[int(i)] = (int(t), [float("nan") if x is None else float(x) for x in v])
        size, hop = int(round(fs * window_sec)), int(round(fs * step_sec))
        mark, ready = state.getCurrentWatermarkMs(), []
        # Only windows that a held sample belongs to can be whole.
        for k in sorted({i // hop - b for i in held for b in range(-(-size // hop))}):
            if k >= frontier and k not in done and all(j in held for j in range(k * hop, k * hop + size)):
                ready.append(k)
        done.update(ready)
        past = max([i for i, (t, _) in held.items() if t < mark], default=-1)
        while frontier in done or frontier * hop + size - 1 <= past:
            done.discard(frontier)
            frontier += 1
        rows = [[held[j][1] for j in range(k * hop, k * hop + size)] for k in ready]
        held = {i: x for i, x in held.items() if i >= frontier * hop}
        order = sorted(held)
        state.update(([*order], [held[i][0] for i in order], [x for i in order for x in held[i][1]],
                      sorted(done), frontier))
        latest = max([t for t, _ in held.values()], default=max(mark, 0))
        state.setTimeoutTimestamp(max(latest, mark) + 1)
        if rows:
            yield pd.DataFrame({**{n: [v] * len(rows) for n, v in zip(keys, key)}, "window_index": ready,
                                **{c: [[x[n] for x in w] for w in rows] for n, c in enumerate(cols)}})

    return (kept.withWatermark(time, delay).groupBy(*keys)
            .applyInPandasWithState(advance, out, _OPEN, "append", GroupStateTimeout.EventTimeTimeout))
