"""Connected components by alternating large-star and small-star over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(spark: SparkSession, edges: DataFrame, ws: Workspace, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long) but the roots; root is the smallest id reachable.

    Each round is a large-star then a small-star step, each one aggregate for the smallest neighbour and one join; edges and
    the hubs' smallest neighbours are written between. Loops, repeats and nulls in `edges` are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u > v").distinct()
    before, last = None, None
    for _ in range(most_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: then both sides of the join are plain exchanges, and a hub's edges are split among tasks
        least = ws.stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        hubs = least
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        seen = Observation()
        e = ws.stage(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        ws.drop(last, hubs)
        last, now = e, (seen.get["n"], seen.get["h"])
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
