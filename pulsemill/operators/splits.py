"""Group splits, folds and unions."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from pulsemill.operators.indexing import dense_index


def group_split(df: DataFrame, group: str, val_fraction: float = 0.2,
                seed: int = 2025) -> DataFrame:
    """Label rows train or val so that no group is on both sides.

    Groups are ordered by md5(seed | group); the first max(1, round(G * fraction)), at
    most G - 1, go to val. Rows without a group go to train. Needs at least two groups.
    """
    if not 0.0 < val_fraction < 1.0:
        raise ValueError("val_fraction must be in (0, 1)")
    groups = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn(
        "__h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string"))))
    total = groups.count()
    if total < 2:
        raise ValueError("need at least two groups to split")
    n_val = min(max(1, int(round(total * val_fraction))), total - 1)
    ordered = dense_index(groups, [], ["__h", group], [F.substring("__h", 1, 4)], "__pos")
    val = ordered.where(F.col("__pos") < n_val).select(
        F.col(group).cast("string").alias("__g"), F.lit(True).alias("__hit"))
    # Rows without a group get a scattered key, so that they do not meet in one task.
    key = F.coalesce(F.col(group).cast("string"),
                     F.concat(F.lit("no group "), F.xxhash64(*[c for c in df.columns if c != "split"]).cast("string")))
    marked = df.drop("split").withColumn("__g", key).join(val, "__g", "left")
    return marked.withColumn("split", F.when(F.col("__hit"), "val").otherwise("train")).drop(
        "__g", "__hit")


def kfold(df: DataFrame, k: int, order: list, levels: list, name: str = "fold") -> DataFrame:
    """Contiguous folds 0..k-1 in `order`; the first n mod k folds get one more row."""
    if k <= 1:
        raise ValueError("k must be greater than 1")
    n = df.count()
    if n < k:
        raise ValueError(f"cannot split {n} rows into {k} folds")
    base, extra = divmod(n, k)
    edge = extra * (base + 1)
    rows = dense_index(df, [], order, levels, "__pos")
    fold = F.when(F.col("__pos") < edge, F.floor(F.col("__pos") / F.lit(base + 1))).otherwise(
        F.lit(extra) + F.floor((F.col("__pos") - edge) / F.lit(base)))
    return rows.withColumn(name, fold.cast("int")).drop("__pos")


def union_manifests(parts: dict) -> DataFrame:
    """Rows of all parts with their origin; columns are matched by name."""
    tagged = [df.withColumn("origin", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
