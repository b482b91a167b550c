"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node of its component. Nodes without an edge are absent."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        spread = materialize(spread, "labels")
        discard(labels)
        up = spread.select(F.col("node").alias("parent"), F.col("label").alias("above"))
        jumped = spread.join(up, spread["label"] == up["parent"]).select("node", "was", F.least("label", "above").alias("label"))
        labels = materialize(jumped, "labels")
        discard(spread)
        if not labels.where("label <> was").limit(1).count():
            discard(both)
            return labels.drop("was")
