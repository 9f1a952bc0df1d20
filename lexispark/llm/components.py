"""Connected components of a table of links, without collecting any of it.

Alternating large-star and small-star rounds: each node hands its neighbours to
the smallest one it knows. Edges never grow in number, and the rounds needed
grow with the logarithm of the longest path. They end when the edges are stars,
which is tested exactly: no node has two roots and no root has one. Every round is written to the
shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two roots, or a root has a root itself: else the edges are stars, and no round changes them."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(u, root) for each node of links (u, v) but the roots themselves; root is the least node of its component."""
    down = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stored(down.distinct(), "links")
    while _unsettled(edges):
        old, edges = edges, stored(_small_star(_large_star(edges)), "stars")
        release(old)
    return edges.withColumnRenamed("v", "root")
