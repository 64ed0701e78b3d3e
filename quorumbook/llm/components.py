"""Connected components of a table of links, by alternating large and small stars.

Every round links the neighbours of a node to the smallest of them; after a number
of rounds that grows with the logarithm of the longest chain each node is linked to
the smallest node of its component alone.  Minima are combined before the shuffle,
so a node with very many links is no heavy group; each round is written to the
shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumbook.llm.tables import written


def _large_star(links: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the least of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link every node and its lesser neighbours to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b")))


def connected(links: DataFrame) -> DataFrame:
    """(a, b), any order: rows (node, component) for all nodes with a link but the least of each component."""
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                    "links")
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now
        links = written(_small_star(_large_star(links)).where("a <> b").distinct(), "links")
