"""Connected components by least-label propagation with pointer jumping, wholly in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connect(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels: node binary, label struct<rank long, node binary>, the least of the component so far; links: a, b binary. Returns labels after the links.

    Links are first brought down to links between components. Each round takes the least label among neighbours and then
    the label of the label; it ends when no label changes."""
    root = lambda node, name: labels.select(F.col("node").alias(node), F.col("label").alias(name))
    ends = links.select("a", "b").join(root("a", "x"), "a").join(root("b", "y"), "b")
    ends = ends.select("x", "y").filter(F.col("x") != F.col("y")).distinct()
    both = materialize(ends.select(F.col("x").alias("own"), F.col("y").alias("other")).union(ends.select("y", "x")).distinct(), "links")
    current = materialize(both.select(F.col("own").alias("root")).distinct().withColumn("label", F.col("root")), "labels")
    if current.isEmpty():
        return labels
    while True:
        offers = both.join(current.select(F.col("root").alias("other"), "label"), "other").groupBy(F.col("own").alias("root")).agg(F.min("label").alias("offer"))
        nearer = current.join(offers, "root", "left").select("root", F.col("label").alias("old"), F.least("label", F.coalesce("offer", "label")).alias("label"))
        roots = nearer.select(F.col("root").alias("at"), F.col("label").alias("further"))
        jumped = nearer.join(roots, F.col("label") == F.col("at"), "left").select("root", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        step = materialize(jumped, "labels")
        current = step.select("root", "label")
        if step.filter(F.col("old") != F.col("label")).isEmpty():
            break
    new = current.select(F.col("label").alias("new"), F.col("root").alias("label"))
    return materialize(labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
