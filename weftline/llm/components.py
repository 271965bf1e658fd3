"""Connected components of an edge table, by alternating large and small stars.

Every round is a handful of grouped minima and joins; edges never leave the executors, and each
round ends in a written table, so that lineage stays short and a lost executor costs one round at most.
The minima combine before they move. The nodes of many edges, whose joins would gather a star in one
task, are joined by broadcast: at most ``MOST_HOT`` of them, whatever the size of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import cut_at, remove

#: Edges of one node that a task may gather at least, and nodes beyond the bound that are broadcast at most.
HOT_EDGES, MOST_HOT = 512, 20_000


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, n_edges: int, own: bool) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of u, or u itself if that is less and ``own``."""
    stars = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if own:
        stars = stars.withColumn("m", F.least("u", "m"))
    # at most n_edges / bound nodes have more edges than the bound
    bound = max(HOT_EDGES, n_edges // MOST_HOT)
    hot = F.broadcast(stars.filter(F.col("n") > bound).select("u", "m"))
    cold = edges.join(hot.select("u"), "u", "left_anti").join(stars.filter(F.col("n") <= bound).select("u", "m"), "u")
    return edges.join(hot, "u").select("u", "v", "m").unionByName(cold.select("u", "v", "m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge in ``edges`` (u, v); root is the component's least node.

    Loops and repeated edges are allowed; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    now, path = cut_at(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = _fingerprint(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, middle = cut_at(_with_least(both, 2 * before[0], True).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        stars = _with_least(large, before[0], False)
        rest = stars.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, written = cut_at(rest.unionByName(stars.filter("v = m").select("u", "v")).distinct())
        remove(spark, path)
        remove(spark, middle)
        now, path = after, written
        found = _fingerprint(now)
        if found == before:
            break
        before = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
