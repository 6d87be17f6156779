"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.common import discard, stored_at

#: Far beyond what halving paths needs for any number of nodes.
MOST_ROUNDS = 200


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node
    of ``edges`` (longs; loops, repeats and either direction are fine).

    Alternates two steps until nothing changes: each node's larger neighbours
    are linked with its smallest neighbour, then its smaller ones with the
    smallest.  Paths halve, so rounds grow with the logarithm of the longest
    path.  Groups are only aggregated, never gathered, so a node may have any
    number of neighbours; each round is a table in the shared folder, and the
    round before it is deleted.
    """
    spark = edges.sparkSession
    current, path = stored_at(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
                              .where("u < v").distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # Each edge now lies from a larger node v to a smaller one u.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(least, "v").select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v"))
                                               .otherwise(F.col("u")).alias("v")).where("u < v").distinct())
        after, new_path = stored_at(small, "edges")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(spark, path)
        current, path = after, new_path
        if (state.n, state.h) == before:
            break
        before = (state.n, state.h)
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return current.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
