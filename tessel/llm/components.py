"""Connected components of an undirected graph of BIGINT nodes, by alternating large and small stars.

Each half-step takes the smallest neighbour of every node (combined before its exchange) and joins it to the edges;
both sides are stored tables, so a node with a large share of all edges is split by Spark's skew join. A half-step
never makes more edges than it has. The rounds grow with the logarithm of the graph's size; should ``max_rounds`` of
them not be enough, that is an error, never a partial result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import discard, stored


def _state(edges: DataFrame) -> tuple:
    """Edges and two 64-bit digests of their set, which no number of edges overflows."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())


def components(edges: DataFrame, folder: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node of its component."""
    spark = edges.sparkSession
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = stored(now, folder, "edges-0"), f"{folder}/edges-0"
    state = _state(now)
    for k in range(1, max_rounds + 1):
        if not state[0]:
            break
        # Large star: u's larger neighbours are tied to the smallest of u and its neighbours.
        both = now.union(now.select("v", "u"))
        lowest = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), folder, f"low-{k}a")
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, folder, f"large-{k}")
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("m")), folder, f"low-{k}b")
        tied = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(lowest.select("u", F.col("m").alias("v")).union(tied).distinct(), folder, f"edges-{k}")
        discard(spark, path, f"{folder}/low-{k}a", f"{folder}/large-{k}", f"{folder}/low-{k}b")
        now, path = new, f"{folder}/edges-{k}"
        if (after := _state(now)) == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    # Every node but the roots has one edge, to its root.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
