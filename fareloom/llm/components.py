"""Connected components of a distributed link table (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _nearest(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the smallest of u and its neighbours; counted map-side, then joined, so that
    the many neighbours of one node are spread and split like any skewed join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("m", "u"))


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node it can reach.

    Nulls and links of a node to itself are left out.  Each round is written to the shared folder;
    rounds end when the edges no longer change, every node then pointing at its root.
    """
    edges = (links.where(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    edges = materialise(edges, "edges")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = _nearest(large.where("u <> v").distinct())
        small = near.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        if mark == (mark := _mark(edges)):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
