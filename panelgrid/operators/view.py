"""Per (bucket, construct, target) cell table (A1-A3, F5, F7, F9) and its selections.

All three metrics are a projection followed by one hash aggregation with a
partial (map-side) step, so a hot construct or target only ever shuffles its
pre-aggregated partial sums.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ViewSpec
from ..functions.arrays import pairs_shortest, value_at_dose
from ..functions.exact import mean, sum_parts
from .cube import default_dose

VIEW_KEYS = ["Bucket_Type", "Construct_Description", "PSV"]
VIEW_COLUMNS = VIEW_KEYS + ["value", "n_tested", "all_nn"]


def compute_view(tidy: DataFrame, metric: str, dilution=None,
                 buckets: Sequence[str] = ("Prime", "Boost1", "Boost2"),
                 extra_keys: Sequence[str] = ()) -> DataFrame:
    """A1 (one dose), A2 (all doses), A3 (log10 potency) straight from tidy rows.

    ``cube.cube_view`` gives the same rows, bit for bit, from the pre-aggregated
    cube; use it where more than one view is taken."""
    keys = list(extra_keys) + VIEW_KEYS
    d = tidy.filter(F.col("Bucket_Type").isin(*buckets))  # F7
    if metric == "pct_neut":
        if dilution is None:
            raise ValueError("a percent view needs a dose: pass a number, a column or 'all'")
        if isinstance(dilution, str) and dilution == "all":
            pairs = d.select(*keys, F.explode(pairs_shortest("DilutionArray", "NeutArray")).alias("p"))
            cells = pairs.select(*keys, F.col("p")["n"].alias("cell_value"))
        else:
            # F9 "rows without a value are dropped" is applied after the partial
            # aggregation (parts skip nulls, empty groups are removed): a row
            # filter here would be pushed below the projection and evaluate the
            # array parse twice.
            asked = dilution if isinstance(dilution, Column) else F.lit(float(dilution))
            cells = d.withColumn("_asked", asked).select(
                *keys, value_at_dose("DilutionArray", "NeutArray", F.col("_asked")).alias("cell_value"))
        return (cells.groupBy(*keys).agg(*sum_parts("cell_value", "v")).filter(F.col("v_n") > 0)
                .select(*keys, mean("v").alias("value"), F.col("v_n").alias("n_tested"), F.lit(False).alias("all_nn")))
    if metric == "log10_ic50":
        g = d.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_tested"), F.sum(F.col("Is_NN").cast("long")).alias("n_nn"), *sum_parts("Log10_IC50", "v"))
        all_nn = F.col("n_nn") == F.col("n_tested")
        return g.select(*keys, F.when(~all_nn, mean("v")).alias("value"), "n_tested", all_nn.alias("all_nn"))
    raise ValueError(f"unknown metric {metric!r}")


def resolve_dilution(cube: DataFrame, spec: ViewSpec):
    """The dose of a request: its own, or the default one (F13) as a scalar subquery."""
    if spec.metric == "pct_neut" and spec.dilution is None:
        return default_dose(cube)
    return spec.dilution


def view_filter(tidy: DataFrame, spec: ViewSpec) -> DataFrame:
    """experiment / target / group selections (empty = all known) of tidy rows
    or of the cube.

    With ``default_group_filter`` an empty group selection keeps the non-blank
    groups only, unless every group is blank (scalar subquery, no driver loop).
    With ``empty_is_none`` (G25) an empty, not absent, list of experiments or
    targets keeps nothing, and an empty list of groups filters nothing.
    """
    f = tidy
    for chosen, column in ((spec.experiments, "Experiment"), (spec.targets, "PSV")):
        if chosen or (spec.empty_is_none and chosen is not None):
            f = f.filter(F.col(column).isin(*chosen))
    if spec.groups:
        f = f.filter(F.col("Group").isin(*spec.groups))
    elif spec.default_group_filter and not (spec.empty_is_none and spec.groups is not None):
        f = f.filter((F.col("Group") != "") | ~any_group(tidy))
    return f


def any_group(tidy: DataFrame) -> Column:
    """Whether some row has a group, as a scalar subquery."""
    return tidy.select(F.coalesce(F.max(F.col("Group") != ""), F.lit(False))).scalar()


def subgroup_filter(df: DataFrame, subgroup: Optional[str], col: str = "Subgroup") -> DataFrame:
    """equality filter; the wildcard keeps everything."""
    from ..config import ALL_CONSTRUCTS
    if subgroup is None or subgroup == ALL_CONSTRUCTS:
        return df
    return df.filter(F.col(col) == subgroup)
