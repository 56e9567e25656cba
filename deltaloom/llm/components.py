"""Connected components by alternating large-star and small-star rounds on DataFrames.

Every round points the larger neighbours of a node, then its smaller ones, to the smallest neighbour; after a number of
rounds logarithmic in the size of the largest component all edges point to its smallest node. The minimum of a node's
neighbours is pre-aggregated where edges are read, so a hub isn't collected anywhere. The edges of a hub meet its minimum
by broadcast, those of other nodes by a shuffle: a hub has more than ``HUB`` edges and more than ``1 / HUBS`` of all, so there
are 2 * HUBS of them at most. Each round is written to the shared folder, so lost executors repeat one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


HUB, HUBS = 1_000, 100_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(src, dst) of longs -> (node, component): the smallest node of each node's component, for nodes with an edge.

    Loops and repeated edges are allowed and say nothing; nulls are left out; no edges give no rows.
    """
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, state = written(now, "edges", "snappy"), None
    many = now.count()
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        hubs = least.where(F.col("n") > max(HUB, many // HUBS)).select("u", F.col("m").alias("of_hub"))
        up = both.where("v > u").join(F.broadcast(hubs), "u", "left")
        large = up.where("of_hub IS NULL").join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(up.where("of_hub IS NOT NULL").select(F.col("v").alias("u"), F.col("of_hub").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = written(small, "edges", "snappy")
        total = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (found := (total["n"], total["h"])) == state:
            break
        state, many = found, total["n"]
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
