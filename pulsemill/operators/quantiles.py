"""Exact quantiles of groups of any size.

Every wanted rank lies in a bin [low, high] of its group's values, at first the whole range. A bin
of more than `bin_rows` rows is narrowed: a mergeable sketch of its values, added up before the shuffle, gives
borders around the rank, and one count says how many rows lie below and inside them. The sketch's
error only decides how wide the new bin is; counts are exact, so the rank stays inside. That is
repeated until the bins are small or hold few different values. Only values inside the last
bins are shuffled, equal ones counted together, and each bin is put in order by itself.
"""

import math

from pyspark.sql import DataFrame, Window, functions as F

from pulsemill.functions.numeric import is_finite
from pulsemill.sources.storage import materialize

BIN_ROWS = 200_000
# Borders are taken from a grid of ranks whose step is well above the sketch's error.
GRID, ACCURACY = 256, 2048
BROADCAST_BINS = 100_000


def _ranks(probs, n):
    """Ranks below and above each quantile of n values."""
    below = {k: F.floor(F.lit(float(p)) * (n - 1)).cast("bigint") for k, p in probs.items()}
    return below, {k: F.least(below[k] + 1, n - 1).cast("bigint") for k in probs}


def exact_quantiles(df: DataFrame, by: list, value: str, probs: dict, bin_rows: int = BIN_ROWS,
                    grid: int = GRID, accuracy: int = ACCURACY) -> DataFrame:
    """One row per group with the linear-interpolated quantiles named in `probs`.

    Missing and non-finite values are left out; a group without values gives no row.
    """
    if not by:
        whole = exact_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs, bin_rows, grid, accuracy)
        return whole.drop("__all")
    by, names = list(by), list(probs)
    rows = df.where(is_finite(value)).select(*by, F.col(value).cast("double").alias("__v"))
    sizes = materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")))
    n = F.col("__n")
    below, above = _ranks(probs, n)
    whole = F.struct(F.lit(0).alias("k"), F.array_distinct(F.array(*below.values(), *above.values())).alias("ranks"))
    own = [F.struct(F.lit(i + 1).alias("k"), F.array_distinct(F.array(below[p], above[p])).alias("ranks"))
           for i, p in enumerate(names)]
    bins = sizes.withColumn("__bin", F.explode(F.when(n > bin_rows, F.array(*own)).otherwise(F.array(whole)))).select(
        *by, F.col("__bin.k").alias("__k"), F.col("__bin.ranks").alias("__ranks"), F.lit(-math.inf).alias("__lo"),
        F.lit(math.inf).alias("__hi"), F.lit(0).cast("bigint").alias("__below"), n.alias("__inside"))
    most = sizes.agg(F.max("__n")).first()[0] or 0
    while most > bin_rows:
        wide = (F.col("__inside") > bin_rows) & (F.col("__lo") < F.col("__hi"))
        narrowed = materialize(_narrow(rows, bins.where(wide), by, grid, accuracy))
        bins = materialize(bins.where(~wide).unionByName(narrowed))
        now = narrowed.where(F.col("__lo") < F.col("__hi")).agg(F.max("__inside")).first()[0] or 0
        if now > 0.75 * most:  # what is left are a few values with many rows each
            break
        most = now
    return _picked(rows, bins, sizes, by, probs)


def _beside(rows, bins, by):
    """Rows with the bins of their group. Bins are broadcast only when they are counted to be few."""
    few = bins.limit(BROADCAST_BINS + 1).count() <= BROADCAST_BINS
    return rows.join(F.broadcast(bins) if few else bins, by)


def _narrow(rows, bins, by, grid, accuracy):
    """The bins with borders closer around their ranks. One scan for the sketches, one for the counts."""
    keys, v = [*by, "__k"], F.col("__v")
    # A source of a few values would give borders beyond the rows inside; all are taken from these rows.
    inside = _beside(rows, bins.select(*keys, "__lo", "__hi"), by).where((v >= F.col("__lo")) & (v <= F.col("__hi")))
    at = inside.groupBy(*keys).agg(
        F.percentile_approx("__v", [k / grid for k in range(grid + 1)], accuracy).alias("__at"))
    at = materialize(bins.join(at, keys))
    size, step = F.col("__inside"), F.lit(float(grid))
    first = F.floor((F.array_min("__ranks") - F.col("__below")) / size * step).cast("int") - 2
    last = F.ceil((F.array_max("__ranks") - F.col("__below") + 1) / size * step).cast("int") + 2
    new = at.withColumns({
        "__lo": F.when(first < 0, F.col("__lo")).otherwise(F.get("__at", F.greatest(first, F.lit(0)))),
        "__hi": F.when(last > grid, F.col("__hi")).otherwise(F.get("__at", F.least(last, F.lit(grid))))}).drop("__at")
    near = _beside(rows, new.select(*keys, "__lo", "__hi"), by)
    counts = near.groupBy(*keys).agg(F.count_if(v < F.col("__lo")).alias("__b"),
                                     F.count_if((v >= F.col("__lo")) & (v <= F.col("__hi"))).alias("__i"))
    return new.drop("__below", "__inside").join(counts, keys).withColumnsRenamed({"__b": "__below", "__i": "__inside"})


def _picked(rows, bins, sizes, by, probs):
    keys, v = [*by, "__k"], F.col("__v")
    inside = _beside(rows, bins.select(*keys, "__lo", "__hi"), by).where((v >= F.col("__lo")) & (v <= F.col("__hi")))
    counted = inside.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    order = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.withColumn("__cum", F.sum("__c").over(order)).join(bins.select(*keys, "__below", "__ranks"), keys)
    upto = F.col("__below") + F.col("__cum")
    hit = F.filter("__ranks", lambda r: (r < upto) & (r >= upto - F.col("__c")))
    found = summed.select(*by, "__v", F.explode(hit).alias("__r")).join(sizes, by)
    below, above = _ranks(probs, F.col("__n"))
    lost = F.raise_error(F.lit("a rank lies outside its bin")).cast("double")
    at = lambda rank: F.coalesce(F.max(F.when(F.col("__r") == rank, v)), lost)
    sides = found.groupBy(*by, "__n").agg(*[at(below[p]).alias(f"__a{k}") for k, p in enumerate(probs)],
                                          *[at(above[p]).alias(f"__z{k}") for k, p in enumerate(probs)])
    below, _ = _ranks(probs, F.col("__n"))
    between = lambda k, p: F.col(f"__a{k}") + (F.col(f"__z{k}") - F.col(f"__a{k}")) * (
        F.lit(float(probs[p])) * (F.col("__n") - 1) - below[p])
    return sides.select(*by, *[between(k, p).alias(p) for k, p in enumerate(probs)])
