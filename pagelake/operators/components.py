"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import discard, stored


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: no centre has an edge of its own and no node has two centres."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e"))
    per = ends.select("e.*").groupBy("node").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("n"))
    return per.filter((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("n") > 1))).isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: link a node's neighbours (larger or not larger ones) to its least neighbour.

    The least neighbour is an aggregate joined back, never a collected neighbourhood, so a node
    with a third of all edges costs no more memory than any other.
    """
    if large:
        arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = arcs.join(least, "u")
    if large:
        linked = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return linked.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (u, v); the component is its least node.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each round written to the shared folder, until
    the edges are stars around least nodes. Edges that are so from the start take no round.
    """
    current = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "component-edges")
    while not _settled(current):
        before, current = current, stored(_star(_star(current, True), False), "component-edges")
        discard(before, free=False)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
