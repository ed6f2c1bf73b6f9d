"""Connected components of an edge table by alternating large and small stars.

Everything stays in tables: each round writes its edges to the shared folder, so lineage stays short and no link or
component reaches the driver, which reads one checksum a round. Hubs meet a table of minima, written beforehand, in a
join whose both sides are shuffled anew, so that Spark can split a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_tables, shared_table


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _least(neighbours: DataFrame) -> DataFrame:
    return shared_table(neighbours.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "minima")


def _star(neighbours: DataFrame, *, large: bool) -> DataFrame:
    """Hang neighbours on the least one: the larger ones only (large), or all of them and the node itself."""
    met = neighbours.join(_least(neighbours).hint("merge"), "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """u, root for every node of edges (u, v: long) but the roots; a root is the least node of its component.

    Rounds go on until the edges stay as they are, which the alternation is proven to reach in O(log^2 n) rounds. Self-links and
    repeated or reversed links have no effect; an empty table gives no rows.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = shared_table(edges, "edges")
    before, after = None, _checksum(edges)
    while after[0] and after != before:
        with scratch_tables(edges.sparkSession) as keep:  # the minima and the large star go with their round
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            edges = shared_table(_star(both, large=True), "large-star")
            edges, _ = keep(_star(edges, large=False), "small-star")
        before, after = after, _checksum(edges)
    return edges.withColumnRenamed("v", "root")
