"""Connected components of a distributed edge list by alternating stars.

Each round replaces edges by stars around the smallest known neighbour
(large-star, then small-star), so the number of rounds is logarithmic in
practice and no task or driver ever holds a component. Rounds are cut by tables
in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, written


def _lowest(low: DataFrame, hubs: bool) -> DataFrame:
    return written(low, "lowest") if hubs else low


def _large_star(edges: DataFrame, hubs: bool = False) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return both.where("v > u").join(_lowest(low, hubs), "u").select(
        F.col("v").alias("u"), F.col("low").alias("v")
    ).where("u != v").distinct()


def _small_star(edges: DataFrame, hubs: bool = False) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down.groupBy("u").agg(F.min("v").alias("low")), hubs)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def smallest_reachable(edges: DataFrame, max_rounds: int = 60, *, hubs: bool = False) -> DataFrame:
    """Rows (node, component) for every node on an edge (u, v): the smallest node that it reaches.

    ``hubs``: nodes may have a large part of all edges. The smallest neighbours are then written before they are joined, so
    that both sides of the join are plain shuffles and the adaptive skew join can split the edges of a hub.
    """
    current = written(edges.select("u", "v").where("u != v").distinct(), "edges")
    state = _state(current)
    for _ in range(max_rounds):
        if not state[0]:
            break
        after = written(_small_star(_large_star(current, hubs), hubs), "edges")
        now = _state(after)
        forget(current)
        current, state, done = after, now, now == state
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    ends = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
