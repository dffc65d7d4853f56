"""Connected components of links, by alternating large and small stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, few_files, written


def nearest(edges: DataFrame) -> DataFrame:
    """(u, low): the smallest of each u and its neighbours v; summed before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = nearest(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every id in a link (u, v) that isn't the smallest of its component, as a written table."""
    edges, mark = written(edges.where("u <> v").distinct(), "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            found = edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))
            found._written_at = edges._written_at
            return found
        mark, old = now, edges
        # A round has no more links than the one before, and one for each of its ends.
        edges = written(few_files(small_star(large_star(old)), 3 * now[0]), "links")
        discard(old)
