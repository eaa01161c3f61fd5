"""Connected components of a graph of any size, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import durable


def _starred(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the least node around it."""
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = edges.select(F.inline(ways))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
    larger = both.where("v > u")
    out = larger.join(least, larger.u == least.node).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v")


def _shrunk(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them; edges have v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("node"), "m")
    moved = edges.join(least, edges.u == least.node).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("node").alias("u"), F.col("m").alias("v"))
    return moved.union(own).where("u > v").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a lesser one, or none and edges from greater ones."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"))
    )))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count("*").alias("edges"))
    return nodes.where("out > 1 OR (out = 1 AND edges > 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u and v) that is not a root itself.

    The root is the least node of the component. Steps repeat until every edge
    leads from a node with no other edge to a root, which takes a number of
    rounds that grows with the logarithm of the longest chain. Only a truth
    value reaches the driver.
    """
    edges = durable(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    )
    while not _is_forest_of_stars(edges):
        edges = durable(_shrunk(_starred(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
