"""Domain views over the given tables, as DataFrames and as SQL for the other engine."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsemill.operators.indexing import dense_index


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark, d, gaps=(23, 29, 31)) -> DataFrame:
    """One record per user at 4 Hz with gaps in every channel."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    e = dense_index(e, ["user_id"], ["ts", "event_id"], [F.to_date("ts")], "i")
    u, ev = F.col("user_id"), F.col("event_id")
    return e.select(
        u.alias("subject_id"), u.alias("record_id"),
        F.when(u % 10 < 6, "train").when(u % 10 < 8, "val").otherwise("test").alias("split"),
        "i", F.lit(4.0).alias("fs"),
        F.when(ev % gaps[0] != 0, ((ev * 31) % 101).cast("double")).alias("ecg"),
        F.when(ev % gaps[1] != 0, F.col("value") * 0.5 + (ev % 7).cast("double")).alias("ppg"),
        F.when(ev % gaps[2] != 0, F.col("value") + 40.0).alias("abp"))


# So few gaps that every split has whole windows of three channels at every scale.
FEW_GAPS = (97, 113, 127)


def few_gaps_sql() -> str:
    out = SQL["samples"]
    for a, b in zip((23, 29, 31), FEW_GAPS):
        out = out.replace(f"event_id % {a} = 0", f"event_id % {b} = 0")
    return out


def two_rates(samples: DataFrame) -> DataFrame:
    """Every third record has twice the rate."""
    return samples.withColumn("fs", F.when(F.col("record_id") % 3 == 0, F.lit(8.0)).otherwise(F.col("fs")))


TWO_RATES_SQL = "select * replace (case when record_id % 3 = 0 then cast(8.0 as double) else fs end as fs) from one_rate"


def shared_ids(samples: DataFrame) -> DataFrame:
    """Two subjects use each record id."""
    return samples.withColumns({"subject_id": F.col("subject_id") % 2, "record_id": F.expr("record_id div 2")})


SHARED_IDS_SQL = "select * replace (subject_id % 2 as subject_id, record_id // 2 as record_id) from own_ids"


def record_manifest(spark, d) -> DataFrame:
    u = F.col("user_id")
    return (table(spark, d, "events").select("user_id").distinct().select(
        u.alias("record_id"), u.alias("subject_id"), F.lit(4.0).alias("fs"),
        F.concat(F.lit("h"), u.cast("string")).alias("hadm_id"),
        F.when(u % 10 < 6, "train").when(u % 10 < 8, "val").otherwise("test").alias("split"),
        F.when(u % 2 == 0, "vitaldb").otherwise("mimic4wdb").alias("source"),
        F.concat(F.lit("/data/"), u.cast("string"), F.lit(".parquet")).alias("parquet"),
        F.lit("records").alias("source_manifest"), u.alias("source_row_index")))


def _pair(line) -> dict:
    pk = F.col("l_partkey")
    return {
        "y_true": F.when(pk % 37 != 0, F.lit(60.0) + F.col("l_extendedprice") / 1000.0),
        "y_pred": F.when(pk % 41 != 0, F.lit(60.0) + F.col("l_quantity") * 1.5)}


def points(spark, d) -> DataFrame:
    """Truth and prediction pairs without a position."""
    w = F.floor(F.col("l_orderkey") / 8.0)
    line = table(spark, d, "lineitem")
    return line.select((w % 97).alias("subject_id"), w.alias("window_id"),
                       *[c.alias(n) for n, c in _pair(line).items()])


def windows(spark, d) -> DataFrame:
    """The same pairs as one row per window."""
    w = F.floor(F.col("l_orderkey") / 8.0)
    line = table(spark, d, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
             "l_quantity"]
    rows = line.select((w % 97).alias("subject_id"), w.alias("window_id"), *order,
                       *[c.alias(n) for n, c in _pair(line).items()])
    made = rows.repartition("subject_id", "window_id").groupBy("subject_id", "window_id").agg(
        F.sort_array(F.collect_list(F.struct(*order, "y_true", "y_pred"))).alias("a"))
    return made.select("subject_id", "window_id", F.col("a.y_true").alias("y_true"),
                       F.col("a.y_pred").alias("y_pred"))


def scalar_preds(spark, d) -> DataFrame:
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("subject_id"), F.col("l_orderkey").alias("case_key"),
        (F.lit(100.0) + q).alias("sbp_true"), (F.lit(60.0) + q * 0.4).alias("dbp_true"),
        (F.lit(75.0) + q * 0.6).alias("map_true"),
        (F.lit(100.0) + q + (disc - 0.05) * 200.0).alias("sbp_pred"),
        (F.lit(60.0) + q * 0.4 + (tax - 0.04) * 150.0).alias("dbp_pred"),
        (F.lit(75.0) + q * 0.6 + (disc - tax) * 100.0).alias("map_pred"))


def manifest_src(spark, d) -> DataFrame:
    k, n, seg = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        k.alias("source_row_index"), n.alias("subject_id"), F.col("c_name").alias("record_id"),
        F.when(seg == "BUILDING", "Training").when(seg == "AUTOMOBILE", "VALID")
        .when(seg == "MACHINERY", " test ").when(seg == "HOUSEHOLD", "Validation")
        .otherwise("holdout").alias("split"),
        F.when(n % 4 == 0, "Vital-DB").when(n % 4 == 1, "MIMIC_IV_WDB")
        .when(n % 4 == 2, "mimic2").otherwise("Site B").alias("source"),
        F.when(k % 17 != 0, F.lit(125.0)).alias("fs"),
        F.when(k % 19 == 0, F.lit(125.5)).otherwise(F.lit(125.0)).alias("file_fs"),
        F.when(k % 13 != 0, F.concat(F.lit("/data/"), F.col("c_name"), F.lit(".parquet")))
        .alias("parquet"),
        F.when(k % 11 == 0, "fs,PPG,art").when(k % 7 == 0, "II,abp")
        .otherwise("II,Pleth,ABP,fs").alias("columns_csv"))


def tau_samples(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    e = dense_index(e, ["user_id"], [F.col("value").desc(), "event_id"],
                    [-F.floor(F.col("value") / 4.0)], "i")
    return e.select(F.col("user_id").alias("segment_id"), "i", F.lit(0.25).alias("dt"),
                    (F.lit(40.0) + F.col("value")).alias("p"), F.lit(35.0).alias("p_inf"))


def epochs(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("epoch"), F.col("l_orderkey").alias("batch"),
        F.col("l_quantity").alias("loss"), F.col("l_discount").alias("val_loss"),
        (F.col("l_partkey") % 5).cast("bigint").alias("n_labels"),
        F.col("l_extendedprice").alias("label_mean"))


def case_embeddings(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("case_key"), "embedding",
        F.col("label").cast("double").alias("target"))


def ensemble(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("window_id"), F.col("l_linenumber").alias("i"),
        F.col("l_extendedprice").alias("sample"))


SPLIT_SQL = ("case when user_id % 10 < 6 then 'train' when user_id % 10 < 8 then 'val' "
             "else 'test' end")

SQL = {
    "samples": f"""
select user_id as subject_id, user_id as record_id, {SPLIT_SQL} as split,
 cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as i,
 cast(4.0 as double) as fs,
 case when event_id % 23 = 0 then null else cast((event_id * 31) % 101 as double) end as ecg,
 case when event_id % 29 = 0 then null else value * 0.5 + cast(event_id % 7 as double) end as ppg,
 case when event_id % 31 = 0 then null else 40.0 + value end as abp from events""",
    "record_manifest": f"""
select distinct user_id as record_id, user_id as subject_id, cast(4.0 as double) as fs,
 'h' || user_id as hadm_id, {SPLIT_SQL} as split,
 case when user_id % 2 = 0 then 'vitaldb' else 'mimic4wdb' end as source,
 '/data/' || user_id || '.parquet' as parquet, user_id as source_row_index from events""",
    "points": """
select cast(floor(l_orderkey / 8.0) as bigint) % 97 as subject_id,
 cast(floor(l_orderkey / 8.0) as bigint) as window_id,
 cast(row_number() over (partition by cast(floor(l_orderkey / 8.0) as bigint)
  order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as bigint) as i,
 case when l_partkey % 37 = 0 then null else 60.0 + l_extendedprice / 1000.0 end as y_true,
 case when l_partkey % 41 = 0 then null else 60.0 + l_quantity * 1.5 end as y_pred from lineitem""",
    "scalar_preds": """
select l_suppkey as subject_id, l_orderkey as case_key,
 100.0 + l_quantity as sbp_true, 60.0 + l_quantity * 0.4 as dbp_true, 75.0 + l_quantity * 0.6 as map_true,
 100.0 + l_quantity + (l_discount - 0.05) * 200.0 as sbp_pred,
 60.0 + l_quantity * 0.4 + (l_tax - 0.04) * 150.0 as dbp_pred,
 75.0 + l_quantity * 0.6 + (l_discount - l_tax) * 100.0 as map_pred from lineitem""",
    "manifest_src": """
select c_custkey as source_row_index, c_nationkey as subject_id, c_name as record_id,
 case c_mktsegment when 'BUILDING' then 'Training' when 'AUTOMOBILE' then 'VALID' when 'MACHINERY' then ' test ' when 'HOUSEHOLD' then 'Validation' else 'holdout' end as split,
 case c_nationkey % 4 when 0 then 'Vital-DB' when 1 then 'MIMIC_IV_WDB' when 2 then 'mimic2' else 'Site B' end as source,
 case when c_custkey % 17 = 0 then null else cast(125.0 as double) end as fs,
 case when c_custkey % 19 = 0 then cast(125.5 as double) else cast(125.0 as double) end as file_fs,
 case when c_custkey % 13 = 0 then null else concat('/data/', c_name, '.parquet') end as parquet,
 case when c_custkey % 11 = 0 then 'fs,PPG,art' when c_custkey % 7 = 0 then 'II,abp' else 'II,Pleth,ABP,fs' end as columns_csv from customer""",
    "tau_samples": """
select user_id as segment_id, cast(row_number() over (partition by user_id order by value desc, event_id) - 1 as bigint) as i,
 cast(0.25 as double) as dt, 40.0 + value as p, cast(35.0 as double) as p_inf from events""",
    "epochs": """
select cast(l_linenumber as int) as epoch, l_orderkey as batch, l_quantity as loss, l_discount as val_loss,
 cast(l_partkey % 5 as bigint) as n_labels, l_extendedprice as label_mean from lineitem""",
    "case_embeddings": """
select vec_id as case_key, embedding, cast(label as double) as target from embeddings""",
    "ensemble": """
select l_orderkey as window_id, l_linenumber as i, l_extendedprice as sample from lineitem""",
}
