"""Connected components of an edge table, by rounds of shuffles.

Two rounds alternate: each vertex first hands the smallest neighbour it knows to
its larger neighbours, then to its smaller ones.  Every round keeps the components
and ends in stars whose centre is the smallest vertex; the number of rounds grows
with the logarithm of the longest path.  Minima are combined before the shuffle
and joined back, so a vertex with very many neighbours is never gathered.  Each
round is cut from its lineage with a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegauge.storage import pinned


def connected_components(edges: DataFrame) -> DataFrame:
    """``vertex``, ``component`` (smallest vertex) for all vertices of ``a``, ``b`` edges.

    An empty table gives no row; edges from a vertex to itself and repeated edges
    change nothing; edges with a null end are ignored.
    """
    pairs = edges.select("a", "b").where("a <> b")
    stars = pinned(pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    if stars.isEmpty():
        return stars.select(F.col("v").alias("vertex"), F.col("u").alias("component"))
    before = None
    while True:
        stars = pinned(_small_star(_large_star(stars)))
        now = stars.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("sum")
        ).first()
        if now == before:
            break
        before = now
    centres = stars.select(F.col("u").alias("v"), "u").distinct()
    return stars.unionByName(centres).select(F.col("v").alias("vertex"), F.col("u").alias("component"))


def _large_star(stars: DataFrame) -> DataFrame:
    """Connect the larger neighbours of each vertex to its smallest neighbour or itself."""
    both = stars.select("v", "u").unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
    larger = stars.select(F.col("u").alias("v"), F.col("v").alias("w"))  # v < w
    return larger.join(least, "v").select(F.col("w").alias("v"), F.col("m").alias("u")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Connect each vertex and its smaller neighbours to the smallest of them."""
    least = stars.groupBy("v").agg(F.min("u").alias("m"))
    moved = stars.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.unionByName(least.select("v", F.col("m").alias("u"))).distinct()
