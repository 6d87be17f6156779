"""Subgroup classification (J4 exact-name join, J5 ordered regex rules, X2, X15).

Classification is a pure function of the construct text.  The exact map is a join
on the normalised name.  A short list of ordered rules is one generated ``CASE
WHEN rlike`` (first match wins) on the row itself, so nothing is joined on the
construct, of which one may hold a third of all rows; a long list, or a rule table
given as a DataFrame, goes through ``rule_index`` on the distinct constructs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Rules
from ..functions.text import norm_name, rsearch, ustrip
from ..session import rows_df, rule_dim
from .rule_index import first_rule

#: Rules that are spelt out in the plan.
INLINE_RULES = 500


def rule_subgroup(text: Column, rules: Rules) -> Column:
    """First matching ordered rule of a short list, else the uncategorized label."""
    s = ustrip(text)
    expr = None
    for pattern, subgroup in rules.pattern_rules:
        cond = rsearch(s, pattern)
        expr = F.when(cond, F.lit(subgroup)) if expr is None else expr.when(cond, F.lit(subgroup))
    return F.lit(rules.uncategorized) if expr is None else expr.otherwise(F.lit(rules.uncategorized))


def _indexed(rules: Rules) -> bool:
    return isinstance(rules.pattern_rules, DataFrame) or len(rules.pattern_rules) > INLINE_RULES


def with_rule_subgroup(df: DataFrame, rules: Rules, text_col: str, out_col: str) -> DataFrame:
    """J5 for every row of ``df``, by the way that suits the number of rules."""
    if not _indexed(rules):
        return df.withColumn(out_col, rule_subgroup(F.col(text_col), rules))
    table = rules.pattern_rules
    if not isinstance(table, DataFrame):
        table = rows_df(df.sparkSession, [(i, p, s) for i, (p, s) in enumerate(table)], "ordinal bigint, pattern string, subgroup string")
    found = first_rule(df.select(F.col(text_col).alias("text")), table).select(F.col("text").alias("_text"), F.col("subgroup").alias("_found"))
    joined = df.join(found, F.col(text_col) == F.col("_text"), "left")
    return joined.withColumn(out_col, F.coalesce("_found", F.lit(rules.uncategorized))).drop("_text", "_found")


def exact_dim(spark, rules: Rules) -> DataFrame:
    """J4 dimension: (name_norm, exact_subgroup); later rows win on collisions."""
    em = rules.exact_map
    if isinstance(em, DataFrame):
        src = em.select(F.col("name"), F.col("subgroup"),
                        (F.col("ordinal") if "ordinal" in em.columns
                         else F.monotonically_increasing_id()).alias("ordinal"))
        dim = (src.groupBy(norm_name("name").alias("name_norm"))
               .agg(F.max_by("subgroup", "ordinal").alias("exact_subgroup")))
        return rule_dim(spark, dim, "", rules.max_broadcast_rows)
    # python rows: resolve collisions on the driver (dict semantics, later wins)
    rows = [(i, n, s) for i, (n, s) in enumerate(em)]
    base = rows_df(spark, rows, "ordinal bigint, name string, subgroup string")
    dim = (base.groupBy(norm_name("name").alias("name_norm"))
           .agg(F.max_by("subgroup", "ordinal").alias("exact_subgroup")))
    return F.broadcast(dim) if len(rows) <= rules.max_broadcast_rows else dim


def classify(df: DataFrame, rules: Rules, text_col: str = "Construct_Description",
             out_col: str = "Subgroup") -> DataFrame:
    """Add ``out_col``: exact normalised-name match first, then ordered rules."""
    spark = df.sparkSession
    dim = exact_dim(spark, rules)
    joined = df.join(dim, norm_name(F.col(text_col)) == dim["name_norm"], "left")
    exact = F.when(F.col("exact_subgroup") != "", F.col("exact_subgroup"))
    return with_rule_subgroup(joined, rules, text_col, "_by_rule").withColumn(out_col, F.coalesce(exact, F.col("_by_rule"))) \
        .drop("name_norm", "exact_subgroup", "_by_rule")


def classified_constructs(cube: DataFrame, rules: Rules,
                          text_col: str = "Construct_Description") -> DataFrame:
    """Distinct constructs of the cube with their row counts and subgroup
    (aggregate first, classify the small result)."""
    per = cube.where("dose IS NULL").groupBy(text_col).agg(F.sum("n_rows").alias("n_rows"))
    return classify(per, rules, text_col)


def with_subgroup(tidy: DataFrame, rules: Rules, text_col: str = "Construct_Description") -> DataFrame:
    """Row-level ``Subgroup`` (see the module for hot constructs)."""
    return classify(tidy, rules, text_col)


def subgroup_order_dim(spark, rules: Rules) -> DataFrame:
    """(subgroup, ordinal) in canonical order (only listed subgroups count as present)."""
    order = list(rules.subgroup_order)
    return F.broadcast(rows_df(spark, list(enumerate(order)), "ordinal int, subgroup string"))
