"""Connected components of a table of links, by label contraction.

Each round every node takes the smallest label among itself and its neighbours, and then
the label of that label. Labels are written each round, so lineage stays short and a lost
executor costs one round at most; nothing but one count reaches the driver. A hub with many
links only appears in aggregations with map-side combine and in joins that adaptive
execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seenscope.plans.materialize import materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links(a, b)``; the label is the smallest node
    of its component. Self-links, repeated links and either direction are allowed; links
    with a null end are ignored."""
    both = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = materialize(both.union(both.select("b", "a")).distinct(), "links")
    smallest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = materialize(smallest.select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("theirs"))
        nearest = (
            both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("near"))
        )
        lower = labels.join(nearest, "node").select(
            "node", "label", F.least("label", "near").alias("low")
        )
        # The label of a label is a node too, so labels jump along chains.
        hop = labels.select(F.col("node").alias("low"), F.col("label").alias("hop"))
        new = materialize(
            lower.join(hop, "low").select(
                "node",
                F.least("low", "hop").alias("label"),
                (F.least("low", "hop") < F.col("label")).alias("moved"),
            ),
            "labels",
        )
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels
