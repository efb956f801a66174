"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.session import write_and_read


def star_minimum(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``low``, the least of u and all its v. The minimum combines in the map tasks."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("low"))
    return edges.join(low, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return star_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller end."""
    stars = star_minimum(edges)
    moved = stars.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(stars.select("u", F.col("low").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes that have an edge, but for the roots; a root is the least node of its component.

    ``edges`` has two columns of one orderable type; direction, repeats and loops do not matter. Every round is written
    to the shared folder, so that the lineage stays short; rounds grow as the logarithm of the longest path, squared at
    most.
    """
    a, b = edges.columns
    now = write_and_read(edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
        now = write_and_read(small_star(large_star(now)), "edges")
