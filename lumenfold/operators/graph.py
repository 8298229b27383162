"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.sources.storage import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of edges (a, b); label is the smallest node of its component.

    A round gives each node the smallest label around it, of those that moved in the last round, and then
    the label of that label, so the number of rounds grows with the logarithm of a component's diameter.
    Each round is a written table. Self-loops are allowed; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").count().select("a", "b"), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")).withColumn("moved", F.col("label") != F.col("node")), "labels")
    while True:
        near = both.join(labels.where("moved").select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        lower = labels.join(near, "node", "left").select("node", "label", F.least("label", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("label").alias("_far"))
        moved = written(lower.join(jump, "_new").select("node", F.least("_new", "_far").alias("label"), (F.least("_new", "_far") != F.col("label")).alias("moved")), "labels")
        dropped(spark, labels)
        labels = moved
        if not labels.where("moved").limit(1).count():
            dropped(spark, both)
            return labels.select("node", "label")
