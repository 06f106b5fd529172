"""Connected components by contraction of whole components and pointer jumping; nothing is collected but one count for each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node of its component. Loops, repeated and reversed edges do no harm; null ends are dropped.

    Every round each root takes its least neighbour as parent; of two that take each other the lesser stays a root. Taking the least neighbour is taking the least edge in the order of
    (lesser end, greater end), so that there are no longer cycles. Parents are followed to their root by jumping, then the edges are drawn between roots. Every root with an edge joins another, so
    the rounds are at most the binary logarithm of the nodes, and the jumps of a round that of its longest chain; both go on until nothing is left. Parents and edges are written to the shared folder.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    links = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = links.select(F.col("x").alias("node"), F.col("x").alias("label")).distinct()
    links = links.where("x <> y")
    while not links.isEmpty():
        picks = links.groupBy("x").agg(F.min("y").alias("up"))
        mutual = picks.select(F.col("x").alias("up"), F.col("up").alias("over"))
        parents = cut(picks.join(mutual, "up").select("x", F.when((F.col("over") == F.col("x")) & (F.col("x") < F.col("up")), F.col("x")).otherwise(F.col("up")).alias("up")))
        changed = True
        while changed:
            above = parents.select(F.col("x").alias("up"), F.col("up").alias("top"))
            new = cut(parents.join(above, "up").select("x", F.col("up").alias("old"), F.col("top").alias("up")))
            changed = not new.where("old <> up").isEmpty()
            parents = new.select("x", "up")
        labels = cut(labels.join(parents.withColumnRenamed("x", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        ends = links.join(parents.withColumnRenamed("up", "p"), "x").select("p", "y").join(parents.select(F.col("x").alias("y"), F.col("up").alias("q")), "y")
        links = cut(ends.where("p <> q").select(F.col("p").alias("x"), F.col("q").alias("y")).distinct())
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
