"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sheaf.llm.shared import staged


def _toward_least(pairs: DataFrame) -> DataFrame:
    """u, v -> u, v and the least v of each u. The key computed after the grouping has both sides
    exchanged for the join, so that AQE can split the rows of a hot u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    spot = F.xxhash64("u").alias("spot")
    return pairs.select("*", spot).join(least.select("*", spot), ["spot", "u"]).select("u", "v", "least")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of u goes to the least of u and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    p = _toward_least(both).filter("v > u")
    return p.select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """u > v in each link: all smaller neighbours of u, and u itself, go to the least of them."""
    p = _toward_least(links)
    moved = p.select(F.col("v").alias("u"), F.col("least").alias("v")).union(p.select("u", F.col("least").alias("v")))
    return moved.filter("u > v").distinct()


def components(links: DataFrame, least_rounds: int = 1) -> DataFrame:
    """node, component: the least node that each linked node reaches. ``links`` has u, v of one
    integer type; self-links and nulls are ignored, repeated and reversed links allowed.

    The number of rounds grows with the logarithm of the longest path; each ends in the shared
    folder. Nothing but a count and a checksum comes to the driver. Nodes without links are absent."""
    now = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v AND u IS NOT NULL AND v IS NOT NULL").distinct()
    now = staged(now, "links")
    mark, rounds = None, 0
    while True:
        sum_of = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (tuple(sum_of) == mark and rounds >= least_rounds) or sum_of[0] == 0:
            break
        mark, rounds = tuple(sum_of), rounds + 1
        now = staged(_small_star(_large_star(now)), "links")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
