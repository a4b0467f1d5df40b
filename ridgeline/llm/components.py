"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, split_hot_join


def _stats(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the component's smallest node.

    Each round is two partially aggregated minima and two joins whose hot hubs are broadcast
    (at most 1 / HOT_SHARE of them), and is written to the shared folder. Loops are ignored;
    an empty table gives an empty result.
    """
    now = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n, mark = _stats(now)
    while n:
        ends = now.select(F.col("u").alias("a"), F.col("v").alias("b")).union(now.select("v", "u"))
        least = ends.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("_n")).select(F.col("a").alias("v"), F.least("a", "b").alias("m"), "_n")
        large = materialize(split_hot_join(now, least, ["v"], "_n", n).select("u", F.col("m").alias("v")).distinct(), "large_star")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        moved = split_hot_join(large, low, ["u"], "_n", n).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "small_star")
        before, (n, mark) = (n, mark), _stats(now)
        if (n, mark) == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
