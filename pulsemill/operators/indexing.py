"""Ordering inside groups of any size.

A plain `row_number() over (partition by key)` puts one key in one task. The helpers
here split every key into ordered blocks first: the heavy work runs per (key, block),
and only one summary row per block meets in a window over the key.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsemill.sources.storage import stored


def _named(exprs) -> dict:
    return {f"__lvl{n}": (F.col(e) if isinstance(e, str) else e) for n, e in enumerate(exprs)}


def dense_index(df: DataFrame, by: list, order: list, levels: list, name: str) -> DataFrame:
    """0-based position of each row inside `by`, following `order`.

    `levels` are coarse-to-fine block expressions that never decrease along `order`
    (a time bucket, a key prefix, `floor(id / 4096)`). They bound how many rows meet in
    one task and do not change the result. `by` and `levels` must not be NULL.
    """
    cols = _named(levels)
    names = list(cols)
    keyed = df.withColumns(cols)
    sizes = keyed.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("__n"))

    offsets = sizes
    for depth in range(len(names), 0, -1):
        keys, parent = by + names[:depth], by + names[:depth - 1]
        siblings = Window.partitionBy(*(parent or [F.lit(0)])).orderBy(names[depth - 1])
        before = siblings.rowsBetween(Window.unboundedPreceding, -1)
        level = (sizes if depth == len(names)
                 else sizes.groupBy(*keys).agg(F.sum("__n").alias("__n")))
        level = level.select(
            *keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(f"__off{depth}"))
        offsets = level if depth == len(names) else offsets.join(level, keys)

    total = sum((F.col(f"__off{d}") for d in range(1, len(names) + 1)), F.lit(0))
    offsets = offsets.select(*by, *names, total.cast("bigint").alias("__off"))
    inside = Window.partitionBy(*by, *names).orderBy(*order)
    return (keyed.withColumn("__pos", F.row_number().over(inside) - F.lit(1))
            .join(offsets, by + names)
            .select(*[F.col(c) for c in df.columns],
                    (F.col("__off") + F.col("__pos")).cast("bigint").alias(name)))


def with_next(df: DataFrame, by: list, pos: str, block: Column, name: str,
              first: str) -> DataFrame:
    """Next larger `pos` in the group (NULL for the last one), and a flag on the first one.

    `block` never decreases along `pos`. The next row is found inside the block; the last
    row of a block takes the first row of the next non-empty block.
    """
    keyed = df.withColumn("__blk", block)
    heads = keyed.groupBy(*by, "__blk").agg(F.min(pos).alias("__head"))
    across = Window.partitionBy(*by).orderBy("__blk")
    heads = heads.select(*by, "__blk", F.lead("__head").over(across).alias("__after"),
                         (F.row_number().over(across) == 1).alias("__lead_blk"))
    inside = Window.partitionBy(*by, "__blk").orderBy(pos)
    return (keyed.withColumns({"__in": F.lead(pos).over(inside),
                               "__one": F.row_number().over(inside) == 1})
            .join(heads, by + ["__blk"])
            .select(*[F.col(c) for c in df.columns],
                    F.coalesce("__in", "__after").alias(name),
                    (F.col("__one") & F.col("__lead_blk")).alias(first)))


def with_halo(df: DataFrame, pos: str, size: int, halo: int, block: str, core: str) -> DataFrame:
    """Copy each row into every block whose extended range holds it.

    Block b owns positions [b*size, (b+1)*size) and also sees `halo` positions on each
    side. `core` is true on the copy that belongs to the owning block.
    """
    p = F.col(pos)
    first = F.floor((p - F.lit(halo)) / F.lit(size))
    last = F.floor((p + F.lit(halo)) / F.lit(size))
    home = F.floor(p / F.lit(size))
    return (df.withColumn(block, F.explode(F.sequence(first, last, F.lit(1))))
            .withColumn(core, F.col(block) == home))


def range_index(df: DataFrame, by: list, order: list, name: str) -> DataFrame:
    """0-based position of each row inside `by`, following `order`, for any data.

    Rows are sorted by ranges whose borders Spark takes from a sample, and written once; a range
    says how many rows of each group it holds, and the numbers of the ranges before are added
    up. `by` must not be NULL; `order` should leave no ties.
    """
    sorted_rows = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    # A range's number is in the high bits, and a row's number inside it in the low ones.
    rows = stored(sorted_rows.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(*by, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (rows.withColumn("__part", part).join(starts, [*by, "__part"])
            .withColumn(name, (F.col("__off") + F.col("__at") - F.col("__first")).cast("bigint"))
            .select(*df.columns, name))
