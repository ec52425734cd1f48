"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, settle


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u > v in every edge: each u's smaller neighbours and u itself are tied to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(e: DataFrame) -> bool:
    """Whether the edges are stars around each component's least node: no node has two smaller ones or is between two others."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable over the undirected edges (a, b).

    Nodes without an edge do not appear.  Null ends and loops are ignored; no
    edges give an empty table.  Each round is written to the shared folder, so
    the plan does not grow with the rounds; the result is written too, and the rounds
    are removed.  The driver sees one bit a round.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.settle(e, "edges")
    for _ in range(max_rounds):
        if _settled(e):
            break
        e = scratch.settle(_small_star(_large_star(e)), "star")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = settle(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    scratch.clear()
    return out
