"""Diagnostics (A12-A14, A17, X14): counters, detected columns, value domains,
grid sizes.

Counters and domains come from the cube, which has every tidy row's keys, doses
and row counts; the sheet itself is only counted.  Domains are in long form
``(domain, ordinal, value)`` so that a large one never has to fit in one array or
on the driver.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import UNKNOWN_BUCKET
from ..functions.status import multiple_title
from ..session import rows_df
from .classify import classified_constructs, classify, subgroup_order_dim
from .prepare import Prepared
from .ranking import ordered_rank


def counters(p: Prepared) -> DataFrame:
    """n_raw, n_after_filter, n_unknown_bucket, n_uncategorized (one row)."""
    unknown = F.col("Bucket_Type") == UNKNOWN_BUCKET
    per = p.cube.where("dose IS NULL").groupBy("Construct_Description").agg(
        F.sum("n_rows").alias("n_rows"), F.sum(F.when(unknown, F.col("n_rows"))).alias("n_unknown"))
    known = F.col("Subgroup") != p.rules.uncategorized
    none = F.lit(0).cast("bigint")
    n_raw = p.raw.select(F.count(F.lit(1))).scalar()
    return classify(per, p.rules).agg(
        F.coalesce(F.sum("n_rows"), none).alias("n_after_filter"), F.coalesce(F.sum("n_unknown"), none).alias("n_unknown_bucket"),
        F.coalesce(F.sum(F.when(~known, F.col("n_rows"))), none).alias("n_uncategorized"),
    ).select(n_raw.cast("bigint").alias("n_raw"), "n_after_filter", "n_unknown_bucket", "n_uncategorized")


def detected_columns(p: Prepared) -> DataFrame:
    """The sheet's column found for each role, null where there is none."""
    found = [(f.name, getattr(p.columns, f.name)) for f in fields(p.columns)]
    return rows_df(p.tidy.sparkSession, found, "role string, column_name string")


def domains(p: Prepared) -> DataFrame:
    """A13 + A14 in long form: (domain, ordinal, value).

    dilutions / experiments / groups (non-blank) / psvs sorted ascending;
    subgroups_present in the canonical subgroup order; buckets_present in the
    bucket order.  One pass over the cube gives all but the subgroups, which
    follow from the distinct constructs."""
    spark = p.tidy.sparkSession
    zero = F.lit(0.0)
    bucket_at = F.array_position(F.array(*[F.lit(b) for b in p.rules.buckets]), F.col("Bucket_Type"))

    def entry(domain: str, place: Column, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(domain).alias("domain"), place.cast("double").alias("_k"), value.alias("value")))

    row = F.col("dose").isNull()
    entries = F.array_compact(F.array(
        entry("dilutions", F.col("dose"), F.col("dose").cast("string"), ~row), entry("experiments", zero, F.col("Experiment"), row),
        entry("groups", zero, F.col("Group"), row & (F.col("Group") != "")), entry("psvs", zero, F.col("PSV"), row),
        entry("buckets_present", bucket_at, F.col("Bucket_Type"), row & (bucket_at > 0))))
    plain = p.cube.select(F.inline(entries)).distinct()
    listed = (classified_constructs(p.cube, p.rules).select(F.col("Subgroup").alias("subgroup")).distinct()
              .join(subgroup_order_dim(spark, p.rules), "subgroup", "inner")
              .select(F.lit("subgroups_present").alias("domain"), F.col("ordinal").cast("double").alias("_k"), F.col("subgroup").alias("value")))
    ranked = ordered_rank(plain.unionByName(listed), ["domain"], [F.col("_k"), F.col("value")], rank_col="ordinal")
    return ranked.select("domain", F.col("ordinal").cast("bigint"), "value")


def grid_sizes(grid: DataFrame, key: str = "Subgroup") -> DataFrame:
    """A17 + X14: constructs × targets per subgroup grid and its title."""
    g = grid.groupBy(key).agg(F.countDistinct("Construct_Description").alias("n_constructs"),
                              F.countDistinct("PSV").alias("n_targets"))
    return g.withColumn("title", multiple_title(F.col(key), F.col("n_constructs"), F.col("n_targets")))
