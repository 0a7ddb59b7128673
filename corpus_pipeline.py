"""From raw documents to packed sequences: quality, line dedup, near-duplicates, benchmark
decontamination, packing. Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but
the last return the columns of the documents they were given.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsemill.llm import decontamination, line_dedup, near_dup, packing, perplexity, tokens
from pulsemill.sources.storage import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return perplexity.classify(docs, labels).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates."""
    return line_dedup.drop_recurring(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    gone = near_dup.link(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return packing.pack(docs, tokens.tokenizer_path(), keep_encoder=False)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates),
          ("benchmarks", benchmarks), ("packing", sequences)]

# The language model and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
