"""Connected components as joins: label exchange with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop, of


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of an undirected edge list; label is the least node of its component.

    Each round takes the least label among neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of the longest path. Labels live in written
    tables; the driver sees only the number of changes. Self-loops and repeated edges do no harm; an empty list
    gives an empty table.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(e.union(e.select("y", "x")).distinct(), "edges")
    labels = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).select(F.col("x").alias("node"), "label"), "labels")
    while True:
        seen = both.join(labels, both["y"] == labels["node"]).select("x", "label")
        least = seen.union(labels.select("node", "label")).groupBy("x").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("_of"), F.col("label").alias("_to"))
        new = least.join(jump, least["label"] == jump["_of"], "left").select(
            F.col("x").alias("node"), F.least("label", "_to").alias("label")
        )
        old = labels.withColumnRenamed("label", "_old")
        table = cut(new.join(old, "node").select("node", "label", (F.col("label") != F.col("_old")).alias("changed")), "labels")
        drop(labels)
        labels = of(table.select("node", "label"), table)
        if not table.where("changed").limit(1).count():
            drop(both)
            return labels
