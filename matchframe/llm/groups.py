"""Connected components, and verdicts per key joined back to many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.plans.stages import staged


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no larger one, or only larger ones.  Runs a job."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up")))).alias("e"))
    per = ends.select("e.*").groupBy("n").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("all"))
    return per.where("up > 1 OR (up = 1 AND all > 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b); the label is the component's smallest node.

    Large-star and small-star rounds on distributed edges, each round staged, until
    every component is a star around its smallest node; a long chain takes a
    logarithmic number of rounds.  Runs jobs for each round.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _all_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y"))
        nexts = small.union(low.select(F.col("a").alias("x"), F.col("m").alias("y"))).where("x <> y")
        edges = staged(nexts.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())


def spread_back(rows: DataFrame, verdict: DataFrame, key: str, salt_by: Column, salts: int = 16) -> DataFrame:
    """Left join of ``rows`` with one verdict row per key; a frequent key is split into ``salts`` keys."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    leaves = salted.select("__salt", key).distinct().join(verdict, key)
    return salted.join(leaves, ["__salt", key], "left").drop("__salt")


def bounded(small: DataFrame, rows: int = 200_000) -> DataFrame:
    """``small`` staged and counted: marked for broadcast up to ``rows`` rows, joined by a shuffle beyond.  Runs a job."""
    small = staged(small)
    return F.broadcast(small) if small.count() <= rows else small
