"""Connected components of an edge table by alternating large and small stars.

Each round links every node's larger neighbours to its smallest neighbour, then its smaller ones,
until the edges no longer change: every node then points at the smallest node it can reach.  Per
round two aggregations and two joins on the edges; no node's neighbours meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    if not large:
        both = both.where(F.col("v") < F.col("u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.where(F.col("v") > F.col("u")).select("m", "v")
    else:
        out = moved.select(F.explode(F.array(F.struct("m", F.col("v").alias("x")), F.struct("m", F.col("u").alias("x"))))
                           .alias("e")).select("e.m", F.col("e.x").alias("v"))
    return out.where(F.col("m") != F.col("v")).select(
        F.least("m", "v").alias("a"), F.greatest("m", "v").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the component's smallest node."""
    now = staged(edges.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        now = staged(_star(_star(now, True), False), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
