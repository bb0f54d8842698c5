"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, functions as F

#: Rounds after which something must be wrong; the number needed grows with the logarithm of the longest path.
MOST_ROUNDS = 60


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; a local folder of our own only where none is set."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or os.path.join(tempfile.gettempdir(), "lodespark-checkpoints"))
    return df.checkpoint()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over (u, v) edges: neighbours above u (large), or those below with u itself (small), point to the smallest of u and its neighbours."""
    if large:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge between two different nodes.

    Self-loops, repeated edges and edges with a null end change nothing. Hubs are no problem: minima are aggregated
    before the shuffle, and the join back is one that AQE can split. Each round ends in a reliable checkpoint.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u != v")
    now = _cut(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        now = _cut(_star(_star(now, large=True), large=False))
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark or found[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        mark = found
    raise RuntimeError("components did not settle")
