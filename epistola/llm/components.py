"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop_scratch, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for each node of ``edges`` (a, b).

    Each round hooks every node to the smallest label beside it and then follows labels to
    their own labels, so rounds grow with the logarithm of a component's diameter. Each round is written to the
    shared folder; the driver reads one count a round. Empty edges give no rows.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        # the smallest label beside each node, offered to the node and to the label it has now
        beside = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        offered = labels.join(beside, "node").select("node", "label", F.least("label", "low").alias("low"))
        hooks = offered.select(F.col("node"), "low").union(offered.select(F.col("label"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        jump = hooks.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = materialize(
            hooks.join(jump, "low", "left").join(labels, "node")
            .select("node", F.least("low", F.coalesce("lower", "low")).alias("new"), "label"),
            "labels",
        )
        changed = new.where("new <> label").limit(1).count()
        drop_scratch(labels)
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            drop_scratch(both)
            return labels.select("node", F.col("label").alias("component"))
