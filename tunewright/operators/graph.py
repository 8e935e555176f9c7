"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunewright.shared import drop, materialize


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Edges(a > b) after one step: every neighbour above a node (large) or below it (small) is linked to the least of its neighbours."""
    down = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
    near = down.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else down
    least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")  # a table, so that a node of very many edges is split in the join
    if large:
        return e.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    linked = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) of every node in edges(a, b); a and b are BIGINT, in any order.

    Large-star links every neighbour above a node to the node's smallest neighbour, small-star links the neighbours below it
    and the node itself to the smallest; a forest of stars is reached in a logarithmic number of rounds. Edges are written to
    the shared folder between rounds and only their number and a sum of hashes come back. Loops and repeated edges are
    harmless; no edges give no rows.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        after = materialize(_star(materialize(_star(current, True), "edges"), False), "edges")
        new = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop(current)
        current = after
        if new == mark:
            break
        mark = new
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
