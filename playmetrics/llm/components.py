"""Connected components by alternating large-star and small-star steps on checkpointed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmetrics.operators.sizing import settle_table


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its smallest node.

    Each step joins edges with one minimum per node, which is aggregated before it is shuffled, so a
    hub costs one row per task. Edges that say nothing new vanish, and the loop ends when a round
    changes nothing; the number of rounds grows with the logarithm of the components' diameter.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = settle_table(both, "edges")
    state = _state(now)
    while state[0]:
        # Large star: larger neighbours of a node move to the smallest of its neighbourhood.
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of a node, and itself, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle_table(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    found = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = found.select("component").distinct().select(F.col("component").alias("node"), "component")
    return found.unionByName(roots)
