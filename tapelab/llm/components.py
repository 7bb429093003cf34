"""Connected components of an edge list, by lowering labels and pointer jumping on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapelab.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); the label is the smallest node of its component.

    Each round takes the smallest label among the neighbours, then the label's own label, so long chains halve. Nothing but a count
    comes to the driver. An empty edge list gives an empty result.
    """
    ab = edges.select("a", "b").where("a <> b")
    both = stage(ab.unionByName(ab.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = stage(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")), "labels")
        if lower.where("moved").isEmpty():
            return labels
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = stage(lower.join(up, "label").select("node", F.least("label", "up").alias("label")), "labels")
