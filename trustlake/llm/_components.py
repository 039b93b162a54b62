"""Connected components of a table of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm._session import forget, stored


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) -> node, label: the smallest node that links lead to.

    Smallest labels move over the links and then jump to their label's label,
    so the rounds grow with the logarithm of a component's diameter. Each round
    is written to the shared folder; no link or label passes the driver.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        to = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        before = labels
        moved = stored(moved.join(to, moved.label == to["at"], "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        forget(before)
        labels = moved.select("node", "label")
        labels._stored_at = moved._stored_at
        if not moved.filter("old <> label").limit(1).count():
            forget(both)
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) of some links' components with further ``links`` (a, b) joined in.

    Only the new links are followed, between the labels of their ends. A node
    without a label is a component of its own.
    """
    ends = links.select("a", "b")
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias(end), F.col("label").alias("own"))
        ends = ends.join(of, end, "left").withColumn(end, F.coalesce("own", end)).drop("own")
    to = components(ends.filter("a <> b"))
    moved = labels.join(to.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    new = to.join(labels.select("node"), "node", "left_anti")
    out = stored(moved.unionByName(new), "labels")
    forget(to)
    return out
