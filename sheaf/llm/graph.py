"""Connected components of edge tables, without collecting edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, release, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): the smallest node that each reaches.

    In each round a node takes the smallest of its label, its neighbours' labels and its label's label, until nothing
    changes, so chains shorten to half or less. Each round is a table in the shared folder; the last one stays.
    Edges and labels are two numbers each, so they are kept in an eighth of the shuffle partitions.
    """
    spark = edges.sparkSession
    parts = max(4, partitions(spark) // 8)
    both, both_path = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().coalesce(parts), "edges")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels, path = staged(first.coalesce(parts), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        lower = labels.join(near, "node").join(jump, "label").select("node", F.col("label").alias("old"), F.least("label", "m", "next").alias("label"))
        after, after_path = staged(lower.coalesce(parts), "labels")
        changed = after.where("old <> label").limit(1).count()
        release(spark, path)
        labels, path = after.select("node", "label"), after_path
        if not changed:
            release(spark, both_path)
            return labels
