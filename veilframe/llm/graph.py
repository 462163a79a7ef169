"""Connected components of a table of edges, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) on tables in the shared folder;
    the rounds grow with the logarithm of the longest path. A node with very many edges is met by
    a join that Spark may split, never by a list of its neighbours.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.table(now, f"{name}-0")
    mark = None
    for k in range(1, most_rounds + 1):
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        # now holds a > b. Large star: a neighbour above u hangs on the least of u's neighbourhood.
        large = now.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        step = small.select("e.a", "e.b").where("a != b").distinct()
        now = scratch.table(step, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
