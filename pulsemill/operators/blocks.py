"""Recordings packed into blocks of samples, and what is worked out on them.

A packed block is one row per (record, block): the positions and one array per channel. Samples are
shuffled once, to be packed; finite runs, moments, peaks and pressures then read arrays. Blocks never
overlap and never grow. What crosses their borders goes through summaries, one small row per block:

- pieces: a segment's part in one block; pieces that touch are stitched by a window over the edge
  pieces of a record, and moments are merged from count, mean and squared deviations;
- flat tops across borders: the first and last run of equal values of every block;
- prominence: whether a peak of height h finds a sample at least P lower before one that is higher,
  beyond its block, depends on h alone and not less for a larger h. So all blocks on one side are summed
  up by one height: from there on the answer is yes. A block changes that height
  H to min(max(H, low), high), a map that composes associatively (`reach`);
- spacing: at most one peak within the minimum distance of a border stays. A block that its own peaks do not
  settle gives a table: for each peak that may stay next to either border, which of its own then stay
  there. The tables of neighbouring blocks agree in exactly one way, found by one scan.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

from pulsemill.operators.peak_rules import (OPEN, agree, border_table, depth_verdicts, find_peaks, piece_extremes,
                                            reach, settle, settled_with)
from pulsemill.sources.storage import materialize

BLOCK = 32768


def pack_blocks(samples: DataFrame, cols: list, keys, block: int = BLOCK) -> DataFrame:
    """One row per (keys, __blk): fs, positions `i` in order, an array per channel."""
    keys = list(keys)
    rows = samples.select(*keys, F.floor(F.col("i") / F.lit(block)).alias("__blk"), "i",
                          F.col("fs").cast("double").alias("fs"),
                          *[F.col(c).cast("double").alias(c) for c in cols])
    # Collecting before the shuffle would not shrink anything, so rows are placed first.
    made = rows.repartition(*keys, "__blk").groupBy(*keys, "__blk").agg(
        F.max("fs").alias("fs"), F.sort_array(F.collect_list(F.struct("i", *cols))).alias("__d"))
    return made.select(*keys, "__blk", "fs", F.col("__d.i").alias("i"),
                       *[F.col("__d").getField(c).alias(c) for c in cols])


def _arrays(batch, *names):
    """Per row the named list columns as numpy arrays; missing numbers are NaN."""
    flat = []
    for n in names:
        c = batch.column(n)
        flat.append((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()))
    for k in range(batch.num_rows):
        yield [v[o[k]:o[k + 1]] for v, o in flat]


def _taken(batch, rows, names):
    at = pa.array(rows, pa.int64())
    return [batch.column(n).take(at) for n in names]


def _moments(cols):
    return [f"{f}_{c}" for c in cols for f in ("__m", "__q")]


def _by_piece(x, a, b):
    """Mean and squared deviations of x in each [a, b), which are in order and do not overlap."""
    n = b - a
    edges = np.ravel(np.column_stack([a, b]))
    padded = np.append(x, 0.0)
    mean = np.add.reduceat(padded, edges)[::2] / n
    which = np.repeat(np.arange(len(a)), n)
    at = np.concatenate([np.arange(s, e) for s, e in zip(a, b)]) if len(a) else np.zeros(0, int)
    return mean, np.bincount(which, (x[at] - mean[which]) ** 2, len(a))


def finite_pieces(packed: DataFrame, cols: list, keys, min_length=1, block: int = BLOCK) -> DataFrame:
    """(keys, __blk, fs, s, e, seg_start, seg_end, mean and deviation per channel): the part in each block of every
    maximal run in which all channels are finite. `min_length`: a number of samples or a column of `fs`."""
    keys, cols = list(keys), list(cols)
    schema = StructType([packed.schema[k] for k in (*keys, "__blk", "fs")] + [
        StructField("s", LongType()), StructField("e", LongType())] + [
        StructField(n, DoubleType()) for n in _moments(cols)])

    def find(batches):
        for batch in batches:
            rows, out = [], [[] for _ in range(2 + 2 * len(cols))]
            for k, (i, *xs) in enumerate(_arrays(batch, "i", *cols)):
                good = np.isfinite(np.stack(xs)).all(axis=0)
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(i[at]) != 1)) + 1
                a, b = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]] + 1
                rows += [k] * len(a)
                values = [i[a], i[b - 1] + 1]
                for x in xs:
                    values += _by_piece(x, a, b)
                for o, v in zip(out, values):
                    o.append(v)
            kinds = [pa.int64()] * 2 + [pa.float64()] * (2 * len(cols))
            found = [pa.array(np.concatenate(o), t) if o else pa.array([], t) for o, t in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(_taken(batch, rows, [*keys, "__blk", "fs"]) + found, names=schema.names)

    pieces = packed.select(*keys, "__blk", "fs", "i", *cols).mapInArrow(find, schema)
    size = F.lit(block)
    edge = (F.col("s") == F.col("__blk") * size) | (F.col("e") == (F.col("__blk") + 1) * size)
    along = Window.partitionBy(*keys, "__edge").orderBy("s")
    new = F.when(F.col("__edge") & (F.lag("e").over(along) == F.col("s")), 0).otherwise(1)
    pieces = (pieces.withColumn("__edge", edge).withColumn("__new", new)
              .withColumn("__grp", F.when(F.col("__edge"), F.sum("__new").over(
                  along.rowsBetween(Window.unboundedPreceding, 0))).otherwise(-1 - F.col("s"))))
    own = Window.partitionBy(*keys, "__edge", "__grp")
    pieces = pieces.withColumns({"seg_start": F.min("s").over(own), "seg_end": F.max("e").over(own)})
    need = F.lit(min_length) if isinstance(min_length, (int, float)) else min_length
    pieces = pieces.where(F.col("seg_end") - F.col("seg_start") >= F.greatest(need, F.lit(1)))
    return _with_moments(pieces.drop("__new"), cols, own).drop("__edge", "__grp")


def _with_moments(pieces, cols, own):
    """Segment mean and population deviation from those of its pieces."""
    n = F.col("e") - F.col("s")
    total = F.sum(n).over(own)
    pieces = pieces.withColumns({f"__mean_{c}": F.sum(n * F.col(f"__m_{c}")).over(own) / total for c in cols})
    spread = {f"__sd_{c}": F.sqrt(F.sum(F.col(f"__q_{c}") + n * F.pow(F.col(f"__m_{c}") - F.col(f"__mean_{c}"), F.lit(2.0)))
                                  .over(own) / total) for c in cols}
    pieces = pieces.withColumns(spread).drop(*_moments(cols))
    return pieces.withColumnsRenamed({f"__mean_{c}": f"__m_{c}" for c in cols})


def segments_of(pieces: DataFrame, keys) -> DataFrame:
    """(keys, seg_start, seg_end), one row per segment."""
    first = F.col("s") == F.col("seg_start")
    return pieces.where(first).select(*keys, "seg_start", "seg_end")


def pieces_of(packed: DataFrame, segments: DataFrame, cols: list, keys, block: int = BLOCK) -> DataFrame:
    """The same rows as `finite_pieces` for segments that are given."""
    keys, cols, size = list(keys), list(cols), F.lit(block)
    cut = segments.select(*keys, "seg_start", "seg_end").withColumn("__blk", F.explode(F.sequence(
        F.floor(F.col("seg_start") / size), F.floor((F.col("seg_end") - 1) / size), F.lit(1))))
    cut = cut.withColumns({"s": F.greatest("seg_start", F.col("__blk") * size),
                           "e": F.least("seg_end", (F.col("__blk") + 1) * size)})
    fields = ["seg_start", "seg_end", "s", "e"]
    joined = _gathered(packed.select(*keys, "__blk", "fs", "i", *cols), cut, keys, fields)
    schema = StructType([packed.schema[k] for k in (*keys, "__blk", "fs")]
                        + [StructField(n, LongType()) for n in fields]
                        + [StructField(n, DoubleType()) for n in _moments(cols)])

    def measure(batches):
        for batch in batches:
            rows, out = [], [[] for _ in range(len(fields) + 2 * len(cols))]
            for k, ((i, *xs), marks) in enumerate(zip(_arrays(batch, "i", *cols), batch.column("__pieces"))):
                at = np.array([[m[f] for f in fields] for m in sorted(marks.as_py(), key=lambda m: m["s"])], np.int64)
                a, b = np.searchsorted(i, at[:, 2]), np.searchsorted(i, at[:, 3])
                some = b > a
                at, a, b = at[some], a[some], b[some]
                rows += [k] * len(a)
                values = list(at.T)
                for x in xs:
                    values += _by_piece(x, a, b)
                for o, v in zip(out, values):
                    o.append(v)
            kinds = [pa.int64()] * 4 + [pa.float64()] * (2 * len(cols))
            found = [pa.array(np.concatenate(o), t) if o else pa.array([], t) for o, t in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(_taken(batch, rows, [*keys, "__blk", "fs"]) + found, names=schema.names)

    return _with_moments(joined.mapInArrow(measure, schema), cols, Window.partitionBy(*keys, "seg_start"))


def _gathered(packed, marks, keys, fields):
    """Packed blocks with the marks that fall into them as one array."""
    per = marks.groupBy(*keys, "__blk").agg(F.collect_list(F.struct(*fields)).alias("__pieces"))
    return packed.join(per, [*keys, "__blk"])


_EXAMINED = [("seg_start", LongType()), ("seg_end", LongType()), ("s", LongType()), ("e", LongType()),
             ("kind", StringType()), ("apart", LongType()), ("open", BooleanType()),
             ("pos", ArrayType(LongType())), ("h", ArrayType(DoubleType())),
             ("left", ArrayType(IntegerType())), ("right", ArrayType(IntegerType())),
             ("first_value", DoubleType()), ("first_end", LongType()), ("first_falls", BooleanType()),
             ("first_right", IntegerType()), ("last_value", DoubleType()), ("last_start", LongType()),
             ("last_rises", BooleanType()), ("last_left", IntegerType()), ("flat", BooleanType()),
             ("highest", DoubleType()), ("from_left", DoubleType()), ("from_right", DoubleType())]


def _examined(packed, pieces, channels, min_distance_sec, keys, block) -> DataFrame:
    """One row per piece and kind. A segment inside one block has its final peaks; a piece of a longer
    one has all its local maxima, what its block says about their prominence, and its summary."""
    keys, kinds = list(keys), list(channels)
    cols = sorted({channels[k][0] for k in kinds})
    fields = ["s", "e", "seg_start", "seg_end", *[f"{f}_{c}" for c in cols for f in ("__m", "__sd")]]
    joined = _gathered(packed.select(*keys, "__blk", "fs", "i", *cols), pieces, keys, fields)
    schema = StructType([packed.schema[k] for k in (*keys, "__blk", "fs")] + [StructField(n, t) for n, t in _EXAMINED])
    arrow = to_arrow_schema(StructType([StructField(n, t) for n, t in _EXAMINED]))

    def one(p, kind, x, rate):
        col, prominence, invert = channels[kind]
        mean, sd = p[f"__m_{col}"], p[f"__sd_{col}"]
        if not sd > 1e-12:
            return None
        z = (-1.0 if invert else 1.0) * ((x - mean) / sd)
        apart = max(1, int(round(min_distance_sec * rate)))
        head = (p["seg_start"], p["seg_end"], p["s"], p["e"], kind, apart)
        if p["s"] == p["seg_start"] and p["e"] == p["seg_end"]:
            found, _ = find_peaks(z, apart, prominence)
            return (*head, False, [p["s"] + q for q in found], *[None] * (len(_EXAMINED) - 8))
        if apart > block:
            raise ValueError(f"peaks {apart} samples apart need blocks of at least that size")
        starts, stops, level, tops = piece_extremes(z)
        left, right = depth_verdicts(level, tops, prominence)
        inner = tops[1:-1]
        return (*head, True, (p["s"] + (starts[inner] + stops[inner] - 1) // 2).tolist(), level[inner].tolist(),
                left[1:-1].tolist(), right[1:-1].tolist(),
                level[0], p["s"] + int(stops[0]), bool(len(level) > 1 and level[1] < level[0]), int(right[0]),
                level[-1], p["s"] + int(starts[-1]), bool(len(level) > 1 and level[-2] < level[-1]), int(left[-1]),
                len(level) == 1, float(level.max()), reach(level, prominence), reach(level[::-1], prominence))

    def run(batches):
        for batch in batches:
            rows, out = [], []
            rates = batch.column("fs").to_pylist()
            for k, ((i, *xs), marks) in enumerate(zip(_arrays(batch, "i", *cols), batch.column("__pieces"))):
                for p in marks.as_py():
                    a, b = np.searchsorted(i, (p["s"], p["e"]))
                    for kind in kinds:
                        made = one(p, kind, xs[cols.index(channels[kind][0])][a:b], rates[k])
                        if made is not None:
                            rows.append(k)
                            out.append(made)
            values = [pa.array([r[c] for r in out], f.type) for c, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(_taken(batch, rows, [*keys, "__blk", "fs"]) + values, names=schema.names)

    return joined.mapInArrow(run, schema)


_SCANNED = StructType([StructField("__seg", StringType()), StructField("__blk", LongType()),
                       StructField("h_left", DoubleType()), StructField("h_right", DoubleType()),
                       StructField("extra", ArrayType(StructType([
                           StructField("pos", LongType()), StructField("h", DoubleType()),
                           StructField("left", IntegerType()), StructField("right", IntegerType())])))])


def scan_summaries(pdf: pd.DataFrame) -> pd.DataFrame:
    """For the pieces of one segment and kind: the heights from which prominence is settled beyond
    either border, and flat tops over borders, at the block that holds their middle."""
    pdf = pdf.sort_values("__blk")
    rows = list(pdf.itertuples(index=False))
    seg, blocks = pdf["__seg"].iloc[0], pdf["__blk"].tolist()

    def heights(order, field):
        out, h = {}, np.inf  # at the end of the segment nothing is lower
        for k in order:
            out[k] = h
            high = getattr(rows[k], field)
            h = min(max(h, min(rows[k].highest, high)), high)
        return out

    left = heights(range(len(rows)), "from_right")
    right = heights(range(len(rows) - 1, -1, -1), "from_left")
    extra = {k: [] for k in range(len(rows))}
    bounds = np.array([r.s for r in rows])

    def top(start, stop, value):
        middle = (start + stop - 1) // 2
        k = int(np.searchsorted(bounds, middle, side="right")) - 1
        r = rows[k]
        extra[k].append({"pos": int(middle), "h": float(value),
                         "left": OPEN if start <= r.s else int(r.last_left),
                         "right": OPEN if stop >= r.e else int(r.first_right)})

    start, value, rises = rows[0].s, rows[0].first_value, False
    for k, r in enumerate(rows):
        if k and r.first_value != value:
            if rises and r.first_value < value:
                top(start, r.s, value)
            start, rises, value = r.s, value < r.first_value, r.first_value
        if not r.flat:
            if rises and r.first_falls:
                top(start, r.first_end, value)
            start, value, rises = r.last_start, r.last_value, bool(r.last_rises)
    return pd.DataFrame({"__seg": seg, "__blk": blocks, "h_left": [left[k] for k in range(len(rows))],
                         "h_right": [right[k] for k in range(len(rows))],
                         "extra": [extra[k] for k in range(len(rows))]})


_SUMMARY = ["__seg", "__blk", "s", "e", "first_value", "first_end", "first_falls", "first_right", "last_value",
            "last_start", "last_rises", "last_left", "flat", "highest", "from_left", "from_right"]


_TABLE = "array<struct<a: bigint, b: bigint, low: bigint, high: bigint>>"
_AGREED = "__seg string, __blk bigint, a bigint, b bigint"


def _agreed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("__blk")
    blk = pdf["__blk"].tolist()
    tables = [[(t["a"], t["b"], t["low"], t["high"]) for t in x] for x in pdf["table"]]
    cuts = [0, *[k for k in range(1, len(blk)) if blk[k] != blk[k - 1] + 1], len(blk)]
    ends = [x for s, e in zip(cuts, cuts[1:]) for x in agree(tables[s:e])]
    return pd.DataFrame({"__seg": pdf["__seg"], "__blk": blk, "a": [x[0] for x in ends], "b": [x[1] for x in ends]})


def _spaced(rows: DataFrame) -> DataFrame:
    """`state` per peak, 1 for those that stay: highest first, later first among equals, `apart` apart."""
    def settling(fn, kind):
        @F.pandas_udf(kind)
        def run(pos: pd.Series, h: pd.Series, state: pd.Series, before: pd.Series, after: pd.Series,
                apart: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([fn(p, v, s, () if b is None else b, () if a is None else a, d, *more)
                              for p, v, s, b, a, d, *more in zip(pos, h, state, before, after, apart, x, y)],
                             dtype=object)
        return lambda *more: run("p.pos", "p.h", "state", "before", "after", "apart", *more)

    def zone(cond):
        return F.filter(F.transform("p", lambda x, k: F.struct(
            x["pos"].alias("pos"), x["h"].alias("h"), F.get("state", k).alias("state"))), cond)

    along = Window.partitionBy("__seg").orderBy("__blk")
    fixed = ["__seg", "__blk", "s", "e", "apart", "p"]

    def beside(rows):
        """The neighbours' peaks near the borders; nothing else travels."""
        zones = rows.select("__seg", "__blk", zone(lambda x: x["pos"] < F.col("s") + F.col("apart")).alias("low"),
                            zone(lambda x: x["pos"] >= F.col("e") - F.col("apart")).alias("high"))
        return zones.select("__seg", "__blk", F.lag("high").over(along).alias("before"),
                            F.lead("low").over(along).alias("after"))

    first = rows.select(*fixed, F.transform("p", lambda _: F.lit(0)).alias("state"))
    alone = settling(lambda *x: settle(*x[:6]), "array<int>")
    now = materialize(first.join(beside(first), ["__seg", "__blk"]).withColumn("state", alone("s", "e"))
                      .select(*fixed, "state"))
    unsure = F.exists("state", lambda s: s == 0)
    if now.where(unsure).isEmpty():
        return now
    open_rows = now.where(unsure).join(beside(now), ["__seg", "__blk"])
    table = settling(lambda *x: [dict(zip("ablh", t)) for t in border_table(*x)], _TABLE.replace("low", "l").replace("high", "h"))
    tables = open_rows.select("__seg", "__blk", table("s", "e").cast(_TABLE).alias("table"))
    agreed = tables.groupBy("__seg").applyInPandas(_agreed, _AGREED)
    done = open_rows.join(agreed, ["__seg", "__blk"]).withColumn("state", settling(settled_with, "array<int>")("a", "b"))
    return now.where(~unsure).unionByName(done.select(*fixed, "state"))


def block_peaks(packed: DataFrame, pieces: DataFrame, channels: dict, min_distance_sec: float, keys,
                block: int = BLOCK) -> DataFrame:
    """Peaks of z-scored signals, one row per (kind, peak), from packed blocks and their pieces.

    `channels`: kind -> (column, prominence, invert). Segments without spread have no peaks."""
    keys = list(keys)
    seen = materialize(_examined(packed, pieces, channels, min_distance_sec, keys, block))
    out = [*keys, "seg_start", "seg_end", "fs", "kind"]
    whole = seen.where(~F.col("open")).select(*out, F.explode("pos").alias("peak"))
    cut = seen.where("open")
    if cut.isEmpty():
        return whole
    seg = F.to_json(F.struct(*keys, "seg_start", "kind"))
    cut = cut.withColumn("__seg", seg)
    scanned = cut.select(*_SUMMARY).groupBy("__seg").applyInPandas(scan_summaries, _SCANNED)

    def verdict(x):
        left = (x["left"] == 1) | ((x["left"] == OPEN) & (x["h"] >= F.col("h_left")))
        right = (x["right"] == 1) | ((x["right"] == OPEN) & (x["h"] >= F.col("h_right")))
        return F.struct(x["pos"].alias("pos"), x["h"].alias("h"), (left & right).alias("good"))

    inner = F.arrays_zip("pos", "h", "left", "right").cast(_SCANNED["extra"].dataType)
    both = cut.join(scanned, ["__seg", "__blk"]).withColumn(
        "p", F.array_sort(F.transform(F.concat(inner, "extra"), verdict)))
    both = materialize(both.select(*out, "__seg", "__blk", "s", "e", "apart", "p"))
    spaced = _spaced(both).select("__seg", "__blk", F.explode(F.filter(F.arrays_zip("p", "state"),
                                  lambda x: (x["state"] == 1) & x["p"]["good"])).alias("x"))
    names = both.select(*out, "__seg", "__blk")
    return whole.unionByName(names.join(spaced, ["__seg", "__blk"]).select(*out, F.col("x.p.pos").alias("peak")))


def span_values(packed: DataFrame, spans: DataFrame, col: str, keys, block: int = BLOCK) -> DataFrame:
    """Highest, lowest and mean value of a channel over each span [start, stop) of a record."""
    keys, size = list(keys), F.lit(block)
    cut = spans.select(*keys, "start", "stop").withColumn("__blk", F.explode(F.sequence(
        F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size), F.lit(1))))
    joined = _gathered(packed.select(*keys, "__blk", "i", col), cut, keys, ["start", "stop"])
    names = ["highest", "lowest", "total", "n"]
    schema = StructType([packed.schema[k] for k in keys] + [StructField("start", LongType()), StructField("stop", LongType())]
                        + [StructField(n, DoubleType()) for n in names])

    def measure(batches):
        for batch in batches:
            rows, starts, stops, out = [], [], [], [[] for _ in names]
            for k, ((i, x), marks) in enumerate(zip(_arrays(batch, "i", col), batch.column("__pieces"))):
                ends = np.array([(m["start"], m["stop"]) for m in marks.as_py()], np.int64)
                a, b = np.searchsorted(i, ends[:, 0]), np.searchsorted(i, ends[:, 1])
                for lo, hi, (start, stop) in zip(a, b, ends.tolist()):
                    v = x[lo:hi]
                    v = v[~np.isnan(v)]
                    if len(v):
                        rows.append(k)
                        starts.append(start)
                        stops.append(stop)
                        for o, f in zip(out, (v.max(), v.min(), v.sum(), float(len(v)))):
                            o.append(f)
            yield pa.RecordBatch.from_arrays(
                _taken(batch, rows, keys) + [pa.array(starts, pa.int64()), pa.array(stops, pa.int64())]
                + [pa.array(o, pa.float64()) for o in out], names=schema.names)

    return joined.mapInArrow(measure, schema).groupBy(*keys, "start", "stop").agg(
        F.max("highest").alias("highest"), F.min("lowest").alias("lowest"),
        (F.sum("total") / F.sum("n")).alias("mean"))
