"""Connected components of an edge table, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node it is connected to) for the edges a, b; both of one orderable type, not null.

    Each round takes the least label among a node's neighbours, then the label of that label; long chains halve.
    Sums and minima are combined before a shuffle, and joins on a much-used node are sort-merge joins of plain
    shuffles, which Spark splits. An empty table gives an empty table; loops and repeated edges change nothing.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = store.cut(store.gathered(both.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")), "edges")
    labels = store.cut(store.gathered(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component"))), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "least").alias("component"))
        hooked = store.cut(store.gathered(hooked), "hooked")
        above = hooked.select(F.col("node").alias("up"), F.col("component").alias("top"))
        jumped = hooked.join(above, F.col("component") == F.col("up")).select("node", "was", F.least("component", "top").alias("component"))
        jumped = store.cut(store.gathered(jumped), "labels")
        labels = jumped.select("node", "component")
        if jumped.where("component != was").isEmpty():
            return labels
