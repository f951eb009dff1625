"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tilespark.functions.storage import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)``, undirected, of any orderable id type -> ``(id, component)``, component being the smallest id reachable.

    Every round contracts neighbourhoods to stars around their minimum (large star, then small star). Only a row count
    and a checksum come to the driver. Self loops and repeated edges are harmless; an empty edge table gives an empty
    result. Nodes without any edge to another node are not returned.
    """
    cur = materialize(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = _digest(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialize(small, "edges")
        now = _digest(nxt)
        discard(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
