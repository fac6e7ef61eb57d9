"""Connected components of a graph given as edges, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all ends of edges (a, b): label is the component's smallest node.

    Each round takes the smallest label among neighbours and then the label of that label; the rounds needed
    grow with the logarithm of a component's diameter. Each round's labels are written, so a lost executor
    repeats one round at most."""
    edges = written(edges.union(edges.select("b", "a")).distinct())
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = edges.join(broadcast_if_small(labels.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = written(step)
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = written(step.join(broadcast_if_small(up), "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("old")).alias("moved")))
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")
