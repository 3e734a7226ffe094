"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import storage

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component: the smallest node reachable, for every node of an edge (a, b).

    Each round moves edges towards smaller nodes (large star, then small star) until only stars
    around the smallest nodes are left. A round is written to the shared folder. Neighbourhoods are
    never gathered: a node's least neighbour is an aggregate with a partial step, and it comes back
    by a join that Spark can split at a hot node. Loops and repeated edges do no harm; no edges give
    no rows.
    """
    now = storage.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = storage.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # Large star: larger neighbours of u go to u's least.
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = storage.written(large.where("u <> v").distinct())
        # Small star: u and its smaller neighbours go to u's least.
        least = storage.written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = storage.written(small.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
    whole = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return whole.union(whole.select(F.col("component").alias("node"), "component").distinct())
