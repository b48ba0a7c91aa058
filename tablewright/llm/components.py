"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b); a component is named by its smallest node.

    Each round a node takes the smallest label among itself and its neighbours, then the label of that label,
    so that the length of paths halves.  Rounds end when no label changes.  Nothing goes to the driver but
    that count; each round's labels are written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        heard = both.join(labels, both.a == labels.node).groupBy("b").agg(F.min("component").alias("heard"))
        near = labels.join(heard, labels.node == heard.b, "left").select(
            "node", F.col("component").alias("old"), F.least("component", "heard").alias("near"))
        far = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        after = stored(near.join(far, "near", "left").select("node", "old", F.least("near", "far").alias("component")))
        labels = after.select("node", "component")
        if after.filter("old <> component").isEmpty():
            return labels
