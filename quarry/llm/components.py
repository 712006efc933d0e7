"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import dropped, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, component), written, and its path: for every node of ``edges`` (u, v) the
    least node that can be reached. Loops and repeated edges don't matter; null ends are
    no edges; without edges the result is empty. Each round is written to the shared
    folder, and what it was made from is deleted."""
    spark = edges.sparkSession
    now, at = written(edges.filter("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    mark = None
    while True:
        after, to = written(small_star(large_star(now)), "edges")
        dropped(spark, at)
        now, at = after, to
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if found == mark or not found[0]:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            out, path = written(stars, "components")
            dropped(spark, at)
            return out, path
        mark = found
