"""Distributed ordered ranking.

A window ``row_number() over (partition by view order by ...)`` sends every row
of a view to one task; with a single view that is the whole table.  Here the
place of a row is a struct (keys, sort columns); splitters of these places cut
the table into buckets of about equal size, rows are numbered inside their
bucket, and shifted by the number of same-key rows in the buckets before it.

Splitters come from the rows with the smallest hashes, a sample that depends on
the rows alone, and a row's bucket from comparing its place with them.  So it
doesn't matter how often or over which partitions Spark evaluates the input:
nothing runs while the plan is built, and nothing is written.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled places for each bucket.
SAMPLED = 16


def splitters(of: DataFrame, columns: Sequence[Column], buckets: int) -> DataFrame:
    """One row, one array ``splitters`` of at most ``buckets - 1`` rising structs
    of ``columns`` that cut the rows into about equal buckets."""
    place = of.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)]).alias("at"))
    sample = place.orderBy(F.xxhash64("at")).limit(SAMPLED * buckets)
    ordered = sample.agg(F.sort_array(F.collect_list("at")).alias("all"))
    nth = F.transform(F.sequence(F.lit(1), F.lit(max(buckets - 1, 1))),
                      lambda i: F.get(F.col("all"), F.floor(F.size("all") * i / F.lit(buckets)).cast("int")))
    return ordered.select(F.array_distinct(F.filter(nth, lambda x: x.isNotNull())).alias("splitters"))


def bucket_of(place: Column, cuts: Column, most: int) -> Column:
    """How many of ``cuts``, a rising array of at most ``most``, lie below ``place`` (binary search)."""
    steps = [1 << k for k in reversed(range(max(most, 1).bit_length()))]
    below = lambda at, step: F.when(F.get(cuts, at + step - 1) < place, at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), below)


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                 rank_col: str = "rank", total_col: Optional[str] = None,
                 num_partitions: Optional[int] = None) -> DataFrame:
    """Add a 1-based ``rank_col`` following ``order`` within each ``keys`` group.

    ``order`` are columns whose rising values give the order (negate a number
    for a falling one); nulls come first.  They must be a total order inside a
    group (end with a unique column) and the same in every evaluation (no
    floating-point sums in the order rows happen to arrive).  ``total_col`` adds
    the group size.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [F.col(k) for k in keys] + list(order)
    cuts = splitters(df, parts, n).scalar()
    place = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(parts)])
    placed = df.withColumns({"_rk_at": place, "_rk_cuts": cuts})
    placed = placed.withColumn("_rk_bucket", bucket_of(F.col("_rk_at"), F.col("_rk_cuts"), n)).drop("_rk_cuts")
    sizes = placed.groupBy(*keys, "_rk_bucket").agg(F.count(F.lit(1)).alias("_rk_n"))
    earlier = Window.partitionBy(*keys).orderBy("_rk_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_rk_before", F.coalesce(F.sum("_rk_n").over(earlier), F.lit(0)))
    if total_col:
        sizes = sizes.withColumn(total_col, F.sum("_rk_n").over(Window.partitionBy(*keys)))
    sizes = sizes.withColumnsRenamed({k: f"_rk_{k}" for k in [*keys, "_rk_bucket"]}).drop("_rk_n")
    inside = Window.partitionBy(*keys, "_rk_bucket").orderBy("_rk_at")
    numbered = placed.withColumn("_rk_inside", F.row_number().over(inside))
    same = F.col("_rk_bucket") == F.col("_rk__rk_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_rk_{k}"))
    out = numbered.join(sizes, same).withColumn(rank_col, F.col("_rk_inside") + F.col("_rk_before"))
    return out.drop("_rk_at", "_rk_bucket", "_rk_inside", "_rk_before", *[f"_rk_{k}" for k in [*keys, "_rk_bucket"]])
