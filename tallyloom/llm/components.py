"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _stamp(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % 1_000_003).alias("s")).first()
    return tuple(r)


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(id, component) of every id in the edges (columns ``u``, ``v`` long); component is the smallest id reachable.

    Large-star hands each node's larger neighbours to the least node near it, small-star the smaller ones; rounds go on
    until edges no longer change, O(log) of the longest path. Each half round is written to the shared folder, which
    cuts lineage and lets adaptive execution split the join at a node with very many neighbours. Nothing but two sums
    comes to the driver.
    """
    spark = ws.spark
    oriented = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = ws.table(oriented, f"{name}-0")
    stamp, k = _stamp(now), 0
    while stamp[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-a{k}")
        large = ws.table(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-b{k}")
        least = ws.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-c{k}")
        moved = large.join(least, "u")
        small = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = ws.table(small.distinct(), f"{name}-{k + 1}")
        ws.drop(f"{name}-{k}", f"{name}-a{k}", f"{name}-b{k}", f"{name}-c{k}")
        now, last, k = new, stamp, k + 1
        stamp = _stamp(now)
        if stamp == last:
            break
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")))
    out = ws.table(ids.groupBy("id").agg(F.min("component").alias("component")), f"{name}-out")
    ws.drop(f"{name}-{k}")
    return spark.read.schema(out.schema).parquet(ws.at(f"{name}-out"))
