"""Manifests and record files."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsemill.functions import fixed
from pulsemill.functions.text import resolve_column

SOURCE_SCHEMA = ("source_row_index bigint, subject_id string, record_id string, "
                 "hadm_id string, fs double, parquet string")


def read_manifest(spark: SparkSession, path: str, schema: str = SOURCE_SCHEMA,
                  limit: int = None) -> DataFrame:
    """Typed CSV manifest with a header; `limit` keeps the first rows by row index."""
    df = spark.read.schema(schema).csv(path, header=True)
    if limit is not None and limit > 0:
        df = df.orderBy("source_row_index").limit(limit)
    return df


def resolve_signals(df: DataFrame, columns: str = "columns") -> DataFrame:
    """Add ecg_col, ppg_col and abp_col from a column-name array."""
    return df.withColumns({
        "ecg_col": resolve_column(columns, fixed.SIGNAL_ALIASES["II"]),
        "ppg_col": resolve_column(columns, fixed.SIGNAL_ALIASES["PLETH"]),
        "abp_col": resolve_column(columns, fixed.SIGNAL_ALIASES["ABP"])})


def inspect_record_files(paths: DataFrame) -> DataFrame:
    """Read the footer of every Parquet file listed in `parquet`.

    Gives columns, resolved signals, first sampling rate, whether a timestamp exists and
    a qualified flag; a file that cannot be read gives its error text instead.
    """
    def look(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs
        for pdf in batches:
            rows = []
            for path in pdf["parquet"]:
                row = {"parquet": path, "file_exists": False, "read_error": None,
                       "columns": None, "file_fs": None}
                try:
                    store, inner = pafs.FileSystem.from_uri(
                        path if "://" in path or path.startswith("file:") else "file://" + path)
                    row["file_exists"] = store.get_file_info(inner).type == pafs.FileType.File
                    if row["file_exists"]:
                        f = pq.ParquetFile(inner, filesystem=store)
                        row["columns"] = list(f.schema_arrow.names)
                        if "fs" in row["columns"] and f.metadata.num_rows > 0:
                            first = f.read_row_group(0, columns=["fs"]).column("fs")[0].as_py()
                            row["file_fs"] = None if first is None else float(first)
                except Exception as e:
                    row["read_error"] = str(e) or type(e).__name__
                rows.append(row)
            yield pd.DataFrame(rows, columns=["parquet", "file_exists", "read_error",
                                              "columns", "file_fs"])

    # A small manifest lies in one partition; the files are spread over as many as a shuffle has.
    spread = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = paths.select("parquet").repartition(spread).mapInPandas(
        look, "parquet string, file_exists boolean, read_error string, "
              "columns array<string>, file_fs double")
    return resolve_signals(seen).withColumns({
        "has_timestamp": F.array_contains("columns", "timestamp"),
        "qualified": F.coalesce(F.col("ecg_col").isNotNull() & F.col("ppg_col").isNotNull()
                                & F.col("abp_col").isNotNull(), F.lit(False))})


def method_columns(df: DataFrame, method: str, include_meta: bool = True,
                   also: list = ()) -> DataFrame:
    """Only the inputs a method may see, its target, meta columns, and those in `also`."""
    inputs, target, _, _ = fixed.METHOD_POLICIES[method]
    absent = [c for c in inputs + [target] if c not in df.columns]
    if absent:
        raise KeyError(f"columns missing for {method}: {absent}")
    keep = inputs + [target]
    if include_meta:
        keep += [c for c in fixed.RECORD_META_COLUMNS if c in df.columns and c not in keep]
    return df.select(*keep, *also)
