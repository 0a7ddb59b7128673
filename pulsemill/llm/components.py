"""Connected components of a table of links."""

from pyspark.sql import DataFrame, functions as F

from pulsemill.sources.storage import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label of that label,
    so long chains shrink fast. Each round is written to shared storage.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct())
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
                         .select(F.col("a").alias("node"), "label"))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy("a").agg(F.min("label").alias("least")))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(step.join(jump, "label").select(
            "node", "old", F.least("label", "next").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
