"""Connected components on DataFrames: smallest labels pass along edges, and labels look up their own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staging


def connected_components(edges: DataFrame, staging: Staging) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); the label is the smallest node that can be reached.

    Each round halves the longest chain of labels at least, so rounds grow with the log of the longest path. Minima are
    taken on both sides of a shuffle, and a node with very many edges meets one row in a join, which Spark can split.
    """
    both = staging.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node")
    labels = staging.write(labels, "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        least = staging.write(least, "least")
        jump = least.select(F.col("node").alias("at"), F.col("new").alias("further"))
        following = staging.write(least.join(jump, F.col("new") == F.col("at"), "left").select("node", "label", F.least("new", F.coalesce("further", "new")).alias("new")), "labels")
        changed = not following.filter("new <> label").isEmpty()
        staging.drop(labels)
        staging.drop(least)
        labels = following.select("node", F.col("new").alias("label"))
        labels._staged_path = following._staged_path
        if not changed:
            staging.drop(both)
            return labels
