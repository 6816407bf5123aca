"""Connected components by alternating large-star and small-star steps, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id in ``links``; ``component`` is the smallest id reachable. Self-links, nulls
    and repeated links are harmless; without links the result is empty. Each step is written to the shared folder. The
    minima are written before they are joined: then both sides of a join are plain exchanges, and Spark splits the rows of
    a star's centre, which may be a third of all, among tasks."""
    u, v = F.greatest(a, b), F.least(a, b)
    edges = written(links.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    before = None
    while True:
        print_of = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if print_of == before or not print_of[0]:
            break
        before = print_of
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m")), "least")
        large = written(both.join(least.hint("merge"), "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")), "large")
        lowest = written(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        pairs = large.join(lowest.hint("merge"), "u")
        small = pairs.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", "m"))
        edges = written(small.where("u != v").distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
