"""Connected components of a graph that lives in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import look_up, stored


def connected_components(edges: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of ``edges(a, b)``.

    Alternates the large-star and small-star steps: each node's neighbours move to its
    least neighbour until every node points at its component's least. The edge table
    never grows, each round is written to the shared folder, and nodes with very many
    neighbours are looked up by a broadcast of the few that can exist.
    Loops (a = b) and repeated edges are harmless; no edges give no rows.
    """
    pairs = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u > v").distinct()
    pairs = stored(pairs, "edges")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("heat"))
        least = least.withColumn("least", F.least("least", "u"))
        large = (
            look_up(both, least, ["u"], "heat", hot_rows)
            .filter("v > u and v > least")
            .select(F.col("least").alias("v"), F.col("v").alias("u"))
            .distinct()
        )
        large = stored(large, "large_star")
        down = large.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("heat"))
        moved = look_up(large, down, ["u"], "heat", hot_rows)
        small = moved.select(F.col("least").alias("v"), F.col("v").alias("u")).union(moved.select(F.col("least").alias("v"), "u"))
        pairs = stored(small.filter("u > v").distinct(), "small_star")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.crc32(F.concat_ws(",", "u", "v").cast("binary")))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
