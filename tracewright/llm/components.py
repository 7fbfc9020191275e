"""Connected components by alternating star contractions, without any driver state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Edges up to which a round's minima are broadcast.
BROADCAST_EDGES = 500_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, component) for every node of an edge; the component is its least node.

    Each round points all larger neighbours of a node at the least one, then
    all smaller ones; the number of rounds is logarithmic in practice.  Minima
    are combined before the shuffle.  Up to BROADCAST_EDGES edges, each round's
    minima are broadcast; beyond, they are staged, so that the joins have two
    plain sides, which adaptive execution splits where a hub is hot.
    Loops, repeats and null ends are ignored.
    """
    stars = staged(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(stars)
    while mark[0]:
        side = F.broadcast if mark[0] <= BROADCAST_EDGES else staged  # a row for each node of an edge at most
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where(F.col("v") > F.col("u")).join(side(low), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = staged(large)
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(side(least), "u").where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        stars = staged(small.unionByName(least.select("u", F.col("low").alias("v"))).distinct())
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    own = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
