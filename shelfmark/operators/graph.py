"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.scratch import drop, new_path, saved, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge table (a, b); component is the least node reached.

    Self-edges and edges with a null end say nothing and are left out, repeated edges count once, and an
    empty table gives an empty result. Each round keeps at most as many edges as it was given, is
    written to the shared scratch folder in place of the one before, and moves every edge nearer a star around its least node; a
    path of n nodes takes on the order of log n rounds. Minima are taken by pre-aggregated groupings and
    joined back, so no node's neighbours meet in one task.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.col("a").isNull().alias("x"), F.col("b").isNull().alias("y"))
    spark, last = edges.sparkSession, None
    edges = written(edges.where("u <> v and not x and not y").select("u", "v").distinct(), "edges")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        path = new_path(spark, "edges")
        edges = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), path)
        if last:
            drop(spark, last)
        last = path
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
