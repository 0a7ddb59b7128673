"""Predictions, metrics documents and result tables."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from pulsemill.functions import fixed
from pulsemill.functions.numeric import finite_or_null, is_finite, parse_finite
from pulsemill.operators.alignment import check_tau_segments


def read_scalar_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Plain or gzip CSV with a header (gzip by file extension)."""
    return spark.read.schema(schema).csv(path, header=True)


def read_tau_segments(spark: SparkSession, path: str) -> DataFrame:
    """Decay segments from Parquet or CSV; bad rows or an empty file raise an error."""
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.csv(path, header=True, inferSchema=False)
    else:
        df = spark.read.parquet(path)
    missing = [c for c in fixed.TAU_SEGMENT_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"segment file lacks columns: {missing}")
    df = df.select(F.col("window_key").cast("string").alias("window_key"),
                   F.col("dia_start").cast("bigint").alias("dia_start"),
                   F.col("dia_end").cast("bigint").alias("dia_end"),
                   F.col("p_inf").cast("double").alias("p_inf"),
                   F.col("target_T").cast("bigint").alias("target_T"))
    bad = check_tau_segments(df).take(1)
    if bad:
        raise ValueError(f"invalid segment row: {bad[0].asDict()}")
    if df.isEmpty():
        raise ValueError("segment file has no rows")
    return df


def read_metrics_json(spark: SparkSession, paths, fields: dict) -> DataFrame:
    """Chosen numbers of nested metrics documents, one row per document.

    `fields`: output name -> dotted path. Absent paths and text such as "nan" give NULL.
    """
    docs = spark.read.text(paths, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("metrics_json"))
    return docs.select("metrics_json", *[
        parse_finite(F.get_json_object("value", "$." + path)).alias(name)
        for name, path in fields.items()])


def read_seed_runs(spark: SparkSession, labelled_paths: dict) -> DataFrame:
    """Long rows (seed_label, method, metric, metric_path, digits, value) of metrics documents.

    `labelled_paths`: label -> file or folder. All are read in one scan; a file has the label of the path
    it lies under."""
    docs = spark.read.option("recursiveFileLookup", True).text(list(labelled_paths.values()), wholetext=True)
    place = F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    label = F.lit(None).cast("string")
    bare = {name: re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/") for name, path in labelled_paths.items()}
    for name, path in sorted(bare.items(), key=lambda x: len(x[1])):
        label = F.when((place == path) | place.startswith(path + "/"), F.lit(name)).otherwise(label)
    cells = F.array(*[F.struct(
        F.lit(m).alias("metric"), F.lit(p).alias("metric_path"), F.lit(d).alias("digits"),
        parse_finite(F.get_json_object("value", "$." + p)).alias("value"))
        for m, p, d in fixed.SEED_METRICS])
    method = F.coalesce(F.get_json_object("value", "$.method_label"),
                        F.get_json_object("value", "$.method"), F.lit(""))
    return docs.select(label.alias("seed_label"), method.alias("method"), F.explode(cells).alias("__c")).select(
        "seed_label", "method", "__c.*")


def _cleaned(c: Column, t: DataType) -> Column:
    """The value with its fields sorted by name and NULL for numbers that are not finite."""
    if isinstance(t, (DoubleType, FloatType)):
        return finite_or_null(c)
    if isinstance(t, StructType):
        return F.when(c.isNotNull(), F.struct(*[
            _cleaned(c.getField(f.name), f.dataType).alias(f.name) for f in sorted(t, key=lambda f: f.name)]))
    if isinstance(t, ArrayType):
        return F.transform(c, lambda x: _cleaned(x, t.elementType))
    if isinstance(t, MapType):
        return F.transform_values(c, lambda k, v: _cleaned(v, t.valueType))
    return c


def write_metrics_json(df: DataFrame, path: str) -> None:
    """One JSON document per row: keys sorted, non-finite numbers written as null, at every depth."""
    cols = [_cleaned(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name)]
    (df.select(*cols).write.mode("errorifexists").option("ignoreNullFields", "false").json(path))


def append_table(df: DataFrame, path: str, columns: list, overwrite: bool = False) -> None:
    """Add rows to a CSV table; an existing header must have the same columns in order."""
    spark = df.sparkSession
    rows = df.select(*columns)
    if not overwrite:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(target):
            header = spark.read.csv(path, header=True).columns
            if header != list(columns):
                raise ValueError(f"existing table has columns {header}")
    rows.write.mode("overwrite" if overwrite else "append").option("header", True).csv(path)


def write_beat_predictions(df: DataFrame, path: str) -> None:
    """Beat predictions as gzip CSV in the fixed column order."""
    absent = [c for c in fixed.BEAT_PREDICTION_COLUMNS if c not in df.columns]
    if absent:
        raise ValueError(f"beat predictions lack columns: {absent}")
    (df.select(*fixed.BEAT_PREDICTION_COLUMNS).write.mode("errorifexists")
     .option("compression", "gzip").option("header", True).csv(path))


def compact_table(metrics: DataFrame) -> DataFrame:
    """Eight-column result row; missing numbers print as empty text.

    `metrics`: method, metrics_json and the six numbers named as in the table.
    """
    shown = [F.when(is_finite(F.col(f"`{c}`")), F.col(f"`{c}`").cast("string"))
             .otherwise(F.lit("")).alias(c) for c, _ in fixed.COMPACT_COLUMNS]
    return metrics.select("method", *shown, "metrics_json")
