"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import delete, release, shared_folder, stored


def _smallest_neighbour(edges: DataFrame, both_ways: bool, path: str) -> DataFrame:
    """One star round on edges (u > v). Minimums are combined before the shuffle and written, so that both sides of the
    join are plain tables: small minimums are broadcast below Spark's size threshold, and a node with very many edges
    is a skewed key that Spark splits over tasks."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    low = stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), path)
    stars = pairs.join(low, "u")
    if both_ways:
        out = stars.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root that hangs on none; as v < u, roots are then the smallest nodes."""
    n, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return n == nodes and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges (u, v) of one comparable type to (node, root): the smallest node reachable, for each node
    with an edge other than to itself. Each round is written to the shared folder; the one before goes."""
    spark = edges.sparkSession
    home = shared_folder(spark, "components")
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{home}/edges-0")
    for k in range(rounds):
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        large = stored(_smallest_neighbour(edges, True, f"{home}/low-{k}-large"), f"{home}/large-{k}")
        edges = stored(_smallest_neighbour(large, False, f"{home}/low-{k}-small"), f"{home}/edges-{k + 1}")
        for old in (f"edges-{k}", f"low-{k}-large", f"large-{k}", f"low-{k}-small"):
            delete(spark, f"{home}/{old}")
        release(spark)
    raise RuntimeError("components didn't settle")
