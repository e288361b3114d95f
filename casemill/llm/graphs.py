"""Connected components as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` for each node of the edges ``a``, ``b``: the smallest node that it reaches.

    Each round points every node at its smallest neighbour, follows the pointers, and contracts the
    edges to where they lead; at least half of the nodes of a component go with each round. Stored
    tables cut the lineage. A hot node has many edges, but all steps are sums by key or joins with one row for a node.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        point = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        point = materialize(point, "pointers")
        for _ in range(2):
            then = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            point = point.join(then, "to").select("node", F.col("next").alias("to"))
        point = materialize(point, "pointers")
        if labels is None:
            labels = point.withColumnRenamed("to", "label")
        else:
            moved = point.select(F.col("node").alias("label"), "to")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = materialize(labels, "labels")
        at_a, at_b = point.select(F.col("node").alias("a"), F.col("to").alias("x")), point.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(at_a, "a").join(at_b, "b").filter("x <> y")
        edges = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
