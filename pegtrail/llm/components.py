"""Connected components of a graph of links by alternating large and small stars.

Each round groups the links by node and joins the least neighbour back, so that a node with very many links is summed
with map-side combine and its join can be split. Links are never gathered for one node and never leave the executors.
Up to `PART_LINKS` links, which are counted first, a round is one task without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegtrail.llm.batches import shared_dir


#: Links that one partition holds: few links in many partitions would cost more in files than in rows.
PART_LINKS = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component): the least node that each linked node reaches; nodes without links have no row.

    Rounds needed grow with the logarithm of a component's size; more than `rounds` raise an error.
    """
    shared_dir(links.sparkSession)
    above = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = above.distinct().checkpoint()
    before, now = None, _state(edges)
    parts = now[0] // PART_LINKS + 1  # no round has more links than there are at first
    edges = edges.coalesce(parts)
    while now != before:
        if not rounds:
            raise RuntimeError("links have not settled in the rounds given")
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = edges.select(F.inline(ways).alias("u", "v"))  # not a union, which would put one partition's links into two
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts).distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # each node's link with its least one stays, its others go to that one
        joined = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = joined.where("u <> v").coalesce(parts).distinct().coalesce(parts).checkpoint().coalesce(parts)
        before, now, rounds = now, _state(edges), rounds - 1
    each = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))
    return edges.select(F.inline(each)).groupBy("node").agg(F.min("component").alias("component")).coalesce(parts)


def _state(edges: DataFrame) -> tuple:
    """The number of links and the sum of their hashes, by which an unchanged round is known."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
