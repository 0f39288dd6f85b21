"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.storage import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for each vertex of ``edges`` (src, dst: longs without nulls); component: the smallest id reachable.

    Each round joins every vertex's larger neighbours to its smallest neighbour (large star), then its smaller
    neighbours to that (small star), until nothing changes; rounds grow as the square of a logarithm at most. Smallest
    neighbours are pre-aggregated minima; they are written before the edges join them, so that both sides of the join
    are plain exchanges, of which the engine splits the partitions of a hub.
    """
    forward = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    current, k, before = scratch.put(forward, "edges0"), 0, None
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    while True:
        now = current.agg(mark).first()[0]
        if now == before or now[0] == 0:
            break
        before, k = now, k + 1
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"large{k}")
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.put(large.distinct(), f"large_edges{k}")
        least = scratch.put(large.groupBy("u").agg(F.min("v").alias("m")), f"small{k}")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = scratch.put(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"edges{k}")
        scratch.drop(f"edges{k - 1}", f"large{k}", f"large_edges{k}", f"small{k}")
    members = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
