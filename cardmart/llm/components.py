"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """a, root for each vertex that is not the smallest of its component. edges: a, b (long), any order, repeats allowed.

    Each round hangs every vertex below its smallest smaller neighbour, turns its other edges into edges
    between those neighbours, and halves the paths. Every join reads written tables, so that a vertex with
    very many edges is split at run time.
    """
    edge = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    while True:
        parent = stored(edge.groupBy("a").agg(F.min("b").alias("p")), "parents")
        above = parent.select(F.col("a").alias("p"), F.col("p").alias("g"))
        hung = parent.join(above, "p", "left").select("a", F.coalesce("g", "p").alias("b"), F.col("g").isNotNull().alias("open"))
        rest = edge.join(parent, "a").where("b <> p").select(F.greatest("b", "p").alias("a"), F.least("b", "p").alias("b"), F.lit(True).alias("open"))
        new = stored(hung.unionByName(rest).groupBy("a", "b").agg(F.max("open").alias("open")), "edges")
        discard(edge)
        discard(parent)
        edge = new.select("a", "b")
        if new.where("open").isEmpty():
            return edge.select("a", F.col("b").alias("root"))
