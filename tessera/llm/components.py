"""Connected components of a graph that is kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """id, root (the smallest id reachable) of every node of edges (a, b).

    Each round sends every node to its smallest neighbour, or itself if it is smaller, follows that pointer once
    more, and contracts the graph. Nodes at least halve in every round. All steps are aggregates that combine
    before the shuffle and joins whose skewed partitions can be split.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    rest = materialize(edges.filter("a <> b").select(a, b).distinct(), "edges")
    found = None
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("u"), F.col("b").alias("v")).union(rest.select("b", "a"))
        near = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "near")
        jump = materialize(near.join(near.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")), "jump")
        found = jump.select(F.col("u").alias("id"), F.col("p").alias("root")) if found is None else found.join(jump.withColumnRenamed("u", "root"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        found = materialize(found, "roots")
        moved = rest.join(jump.select(F.col("u").alias("a"), F.col("p").alias("x")), "a").join(jump.select(F.col("u").alias("b"), F.col("p").alias("y")), "b")
        rest = materialize(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return rest.select(F.col("a").alias("id"), F.col("b").alias("root")) if found is None else found
