"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of edges (a, b); loops and repeats are fine.

    Every step joins edges with one row per node, so no component is ever gathered; the number of steps
    grows with the logarithm of the longest path.
    """
    up = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    current, mark = materialize(up, "edges"), None
    while True:
        facts = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (facts["n"], facts["h"]) == mark or not facts["n"]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = (facts["n"], facts["h"])
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "edges")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
