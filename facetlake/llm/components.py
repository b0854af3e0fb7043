"""Connected components by contraction, as joins of tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected links (a, b); the label is one of the component's nodes.

    Each round points every node at the first of itself and its neighbours in a hashed
    order and replaces links by those between the nodes pointed at. The hash keeps
    long chains of rising ids from shrinking by one node a round: their number falls
    by a constant share instead. Rows that repeat, loops and both directions of a link
    are harmless; an empty table gives no labels.
    """
    pairs = links.select("a", "b").where("a <> b")
    edges = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("p"))
        first = edges.groupBy("a").agg(F.min(ranked("b")).alias("b")).select("a", F.least(ranked("a"), F.col("b")).alias("m"))
        parents = stored(first.select("a", F.col("m.p").alias("p")), "parents")
        if labels is None:
            labels = parents.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            up = parents.select(F.col("a").alias("label"), "p")
            labels = stored(labels.join(up, "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        left = edges.join(parents.withColumnRenamed("p", "pa"), "a")
        both = left.join(parents.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        edges = stored(both.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
