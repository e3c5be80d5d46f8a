"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rounds after which a defect is reported rather than looped on; each round at least halves a path.
MOST_ROUNDS = 64


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b longs): root is the component's smallest node.

    Only counts and checksums come to the driver. Edges with a null end or equal ends
    are ignored. Every node appears once; a node of no edge does not appear.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, before = cut(now.distinct()), None
    for _ in range(MOST_ROUNDS):
        # large star: a node's larger neighbours move to the smallest of its neighbourhood
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours move to the smallest of those
        large = large.where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(moved.union(small.select("a", F.col("m").alias("b"))).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"no fixed point in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
