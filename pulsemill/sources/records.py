"""Signal records: canonical columns, exports, window storage."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsemill.functions import fixed
from pulsemill.operators.indexing import dense_index
from pulsemill.sources.manifests import method_columns


META_FILLS = ["fs", "subject_id", "hadm_id"]


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Samples of every record file of a unified manifest, standardised, with `i` and `parquet`.

    Each file gives its own `ecg_col`, `ppg_col` and `abp_col` and the optional timestamp, fs,
    subject_id and hadm_id; no other column is read. `i` is the row's place in its file. Files of
    the same column names are read together; their paths pass through the driver, as those of any
    scan do. The path is the identity of a record, so record ids may repeat between subjects.
    """
    signals = ["ecg_col", "ppg_col", "abp_col"]
    # Paths come one by one; the list that a scan needs is the only place where they meet.
    listed = {}
    named = manifest.where(F.col("parquet").isNotNull()).select(*signals, "parquet").distinct()
    for r in named.toLocalIterator():
        listed.setdefault(tuple(r[c] for c in signals), []).append(r["parquet"])
    parts = []
    for names in sorted(listed):
        raw = spark.read.option("mergeSchema", True).parquet(*sorted(listed[names]))
        found = {c.lower(): c for c in raw.columns}
        meta = {c: "double" if c == "fs" else "string" for c in META_FILLS}
        parts.append(raw.select(
            _bare_path("_metadata.file_path").alias("parquet"), F.col("_metadata.row_index").alias("i"),
            *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(names, ("ecg", "ppg", "abp"))],
            *[F.col(f"`{found['timestamp']}`").cast("string").alias("timestamp") if "timestamp" in found
              else F.lit(None).cast("string").alias("timestamp")],
            *[(F.col(f"`{found[c]}`") if c in found else F.lit(None)).cast(t).alias(c)
              for c, t in meta.items()]))
    if not parts:
        raise ValueError("the manifest lists no record file")
    return standardize_records(reduce(DataFrame.unionByName, parts),
                               manifest.withColumn("parquet", _bare_path("parquet")))


def _bare_path(c: str) -> Column:
    """A path without its scheme and host; a manifest may leave them out."""
    return F.regexp_replace(F.col(c), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def record_key(samples: DataFrame, manifest: DataFrame) -> list:
    """What identifies a record on both sides: the file's path, else subject and record."""
    both = [c for c in ("parquet", "subject_id", "record_id") if c in samples.columns and c in manifest.columns]
    return ["parquet"] if "parquet" in both else both


def standardize_records(samples: DataFrame, manifest: DataFrame, ecg="ecg", ppg="ppg",
                        abp="abp") -> DataFrame:
    """Canonical II / PLETH / ABP with meta columns filled from the manifest.

    A meta column that is absent or entirely NULL within a record takes the manifest
    value; split and source always come from the manifest. Records are told apart by
    `record_key`; samples without a subject are matched by their record alone. Whether a column
    is entirely NULL is one aggregated row per record, joined on with the manifest.
    """
    key = record_key(samples, manifest)
    have = [c for c in META_FILLS if c in samples.columns]
    known = samples.groupBy(*[F.col(c).alias(f"__k_{c}") for c in key]).agg(
        *[F.count(c).alias(f"__n_{c}") for c in have])
    meta = manifest.select(
        F.col("record_id").alias("__record_id"), F.col("split").alias("__split"),
        F.col("source").alias("__source"), *[F.col(c).alias(f"__j_{c}") for c in key],
        *[(F.col(c) if c in manifest.columns else F.lit(None).cast("string")).alias(f"__m_{c}")
          for c in META_FILLS])
    same = [F.col(f"__j_{c}") == F.col(f"__k_{c}") if c != "subject_id"
            else F.col("__k_subject_id").isNull() | (F.col("__j_subject_id") == F.col("__k_subject_id"))
            for c in key]
    per_record = known.join(meta, reduce(Column.__and__, same)).drop(*[f"__j_{c}" for c in key])
    rows = samples.drop("split", "source").join(per_record, reduce(
        Column.__and__, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in key]))

    def filled(c):
        if c not in have:
            return F.col(f"__m_{c}").alias(c)
        return F.when(F.col(f"__n_{c}") == 0, F.col(f"__m_{c}")).otherwise(F.col(c)).alias(c)

    also = [c for c in ("timestamp", "parquet") if c in samples.columns]
    return rows.select("i", F.col(ecg).alias("II"), F.col(ppg).alias("PLETH"),
                       F.col(abp).alias("ABP"), *also, *[filled(c) for c in META_FILLS],
                       F.col("__record_id").alias("record_id"),
                       F.col("__split").alias("split"), F.col("__source").alias("source"))


EXPORT_BUCKETS = 32


def record_bucket(subject_id, record_id, buckets: int = EXPORT_BUCKETS) -> Column:
    """The bucket of a record in an export."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (subject_id, record_id)]
    return F.pmod(F.xxhash64(*text), F.lit(buckets)).cast("int")


def _record_columns(rows: DataFrame):
    return [F.col(c) if c in rows.columns else F.lit(None) for c in ("subject_id", "record_id")]


def export_method_view(samples: DataFrame, manifest: DataFrame, method: str, path: str,
                       buckets: int = EXPORT_BUCKETS) -> DataFrame:
    """Write a method's view of every record; return the export manifest.

    `samples` are standardised records with `i`. Rows lie in folders by split and record bucket, and inside
    in the order of subject, record and `i`, so that one record is found by its folder and the
    statistics of its row groups. A long record goes over many files. The manifest has one row per record,
    told apart by split, subject and record. `exported_parquet` is the folder that holds the record's rows;
    `read_export` and `read_record` give them back.
    """
    view = method_columns(samples, method, also=["i"])
    placed = view.withColumn("record_bucket", record_bucket(*_record_columns(view), buckets))
    order = ["split", "record_bucket", *[c for c in ("subject_id", "record_id") if c in view.columns], "i"]
    (placed.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("errorifexists").partitionBy("split", "record_bucket").parquet(path))
    inputs, target, _, _ = fixed.METHOD_POLICIES[method]
    key = ["split", *[c for c in ("subject_id", "record_id") if c in view.columns and c in manifest.columns]]
    counts = placed.groupBy(*key, "record_bucket").agg(F.count(F.lit(1)).alias("num_rows"))
    rows = counts.join(manifest, key)
    listed = F.to_json(F.array(*[F.lit(c) for c in inputs]))
    rows = dense_index(rows, [], ["source_row_index"],
                       [F.floor(F.col("source_row_index") / F.lit(65536))], "export_index")
    hadm = F.col("hadm_id") if "hadm_id" in rows.columns else F.lit(None).cast("string")
    folder = F.concat(F.lit(path.rstrip("/") + "/split="), "split", F.lit("/record_bucket="),
                      F.col("record_bucket").cast("string"))
    return rows.withColumns({
        "baseline_key": F.lit(method), "hadm_id": hadm, "input_columns": listed,
        "target_column": F.lit(target), "source_parquet": F.col("parquet"), "exported_parquet": folder,
    }).select(*fixed.EXPORT_MANIFEST_COLUMNS)


def _read_folders(spark: SparkSession, folders: list) -> DataFrame:
    return spark.read.option("basePath", folders[0].rsplit("/split=", 1)[0]).parquet(*folders).drop("record_bucket")


def read_export(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The samples of the records that an export manifest lists, with their split.

    Only the folders it names are read (at most splits times buckets), with the columns of the method's view.
    """
    folders = sorted(r[0] for r in manifest.select("exported_parquet").distinct().collect())
    if not folders:
        raise ValueError("the export manifest lists no record")
    rows = _read_folders(spark, folders)
    key = [c for c in ("split", "subject_id", "record_id") if c in rows.columns]
    return rows.join(manifest.select(*key).distinct(), key, "left_semi")


def read_record(spark: SparkSession, path: str, split: str, subject_id, record_id,
                buckets: int = EXPORT_BUCKETS) -> DataFrame:
    """One record of an export: its bucket alone is scanned, and of that the row groups that may hold it."""
    rows = spark.read.parquet(path)
    same = (F.col("split") == split) & (F.col("record_bucket") == record_bucket(
        F.lit(subject_id), F.lit(record_id), buckets))
    for c, v in (("subject_id", subject_id), ("record_id", record_id)):
        if c in rows.columns:
            same = same & F.col(c).eqNullSafe(F.lit(v).cast(rows.schema[c].dataType))
    return rows.where(same).drop("record_bucket")


def write_windows(windows: DataFrame, path: str) -> None:
    """Windows or embeddings with their arrays, one folder per split."""
    windows.write.mode("errorifexists").partitionBy("split").parquet(path)
