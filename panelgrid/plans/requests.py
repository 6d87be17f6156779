"""Many requests in one plan.

Requests are a table: one row has the metric, dose, lists, thresholds and order of
one view.  It is joined to the cube, and every later step is keyed by the request,
so fifty dashboards are one aggregation, one ranking and one dense grid instead of
fifty plans.

The lists are resolved on the distinct (experiment, group) pairs of the cube.  A
pair and a request meet by equal keys: the request has a key for each listed
experiment and group, or a sign for "any"; the pair has its own name and that sign.
So no request is compared with every row, and a request only meets the pairs it
selects.  The cube's rows then join on (experiment, group); targets, bucket and
subgroup are conditions on what the request brought along.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ALL_CONSTRUCTS, DOSE_TOLERANCE, ViewSpec
from ..functions.exact import PARTS, mean, parts
from ..functions.status import breadth_label
from ..operators.classify import classify
from ..operators.cube import VIEW_KEYS, default_dose
from ..operators.grid import build_grid, encode_cells
from ..operators.prepare import Prepared
from ..operators.view import any_group
from ..session import rows_df

REQUEST = ("spec_id string, metric string, dilution double, all_doses boolean, mode string, threshold double, ge boolean, bucket string, "
           "subgroup string, sort_by string, sort_descending boolean, use_genotype boolean, experiments array<string>, targets array<string>, groups array<string>, "
           "any_experiment boolean, any_target boolean, any_group boolean, blank_groups boolean")


def request_table(spark, specs: Mapping[str, ViewSpec]) -> DataFrame:
    """A table of named specs.  ``any_*`` say that a list does not restrict;
    ``blank_groups`` that an unrestricted group may be blank."""
    rows = []
    for spec_id, s in specs.items():
        anything = lambda chosen, s=s: not chosen and (chosen is None or not s.empty_is_none)
        all_doses = s.dilution == "all"
        rows.append((spec_id, s.metric, None if all_doses or s.dilution is None else float(s.dilution), all_doses, s.mode,
                     0.0 if s.threshold is None else float(s.threshold), s.ge is None or bool(s.ge), s.bucket or "All", s.subgroup,
                     s.sort_by, bool(s.sort_descending), bool(s.use_genotype), list(s.experiments or ()), list(s.targets or ()), list(s.groups or ()),
                     anything(s.experiments), anything(s.targets), not s.groups,
                     not s.default_group_filter or (s.empty_is_none and s.groups is not None)))
    return rows_df(spark, rows, REQUEST)


def _selected(cube: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request with every (Experiment, Group) it selects."""
    own = lambda c: F.concat(F.lit("="), c)
    pairs = cube.select("Experiment", "Group").distinct().withColumn("_any", any_group(cube))
    known = F.when((F.col("Group") != "") | ~F.col("_any"), F.lit("any known"))
    pairs = pairs.select("Experiment", "Group", F.explode(F.array(own(F.col("Experiment")), F.lit("any"))).alias("_e"),
                         F.array_compact(F.array(own(F.col("Group")), F.lit("any"), known)).alias("_gs"))
    pairs = pairs.select("Experiment", "Group", "_e", F.explode("_gs").alias("_g"))
    listed = lambda c: F.array_distinct(F.transform(c, own))
    unlisted = F.when(F.col("blank_groups"), F.lit("any")).otherwise(F.lit("any known"))
    asked = requests.withColumn("_e", F.explode(F.when(F.col("any_experiment"), F.array(F.lit("any"))).otherwise(listed("experiments"))))
    asked = asked.withColumn("_g", F.explode(F.when(F.col("any_group"), F.array(unlisted)).otherwise(listed("groups"))))
    return pairs.join(asked, ["_e", "_g"]).drop("_e", "_g")


def many_views(p: Prepared, requests: DataFrame) -> DataFrame:
    """The view rows of all requests, keyed by the struct ``request``."""
    cube = p.cube
    chosen = _selected(cube, requests).select(
        "Experiment", "Group", "any_target", "targets", F.coalesce("dilution", default_dose(cube)).alias("_asked"), "all_doses",
        F.struct("spec_id", "metric", "mode", "threshold", "ge", "bucket", "subgroup", "sort_by", "sort_descending", "use_genotype").alias("request"))
    rows = cube.where(F.col("Bucket_Type").isin(*p.rules.buckets)).join(chosen, ["Experiment", "Group"])
    rows = rows.where(F.col("any_target") | F.array_contains("targets", F.col("PSV")))
    log, potency = F.col("request.metric") == "log10_ic50", F.col("dose").isNull()
    near = lambda d: F.abs(d - F.col("_asked")) < DOSE_TOLERANCE
    rows = rows.where(F.when(log, potency).when(F.col("all_doses"), ~potency).otherwise(near(F.col("dose")) | F.col("rest").isNotNull()))
    rows = rows.withColumn("_hit", F.get(F.filter("rest", lambda x: near(x["d"])), 0)["n"])
    late = parts("_hit", "n_rows")
    measured = [F.sum(F.when(log, F.col(f"log_{k}")).when(F.col("all_doses"), F.col(f"pair_{k}")).when(potency, late[k]).otherwise(F.col(f"first_{k}"))).alias(f"v_{k}")
                for k in PARTS]
    log_rows = lambda c: F.sum(F.when(log, F.col(c)))
    g = rows.groupBy("request", *VIEW_KEYS).agg(*measured, log_rows("n_rows").alias("n_rows"), log_rows("n_nn").alias("n_nn"))
    all_nn = F.coalesce(F.col("n_nn") == F.col("n_rows"), F.lit(False))
    v = g.where(log | (F.col("v_n") > 0)).select(
        "request", *VIEW_KEYS, F.when(~all_nn, mean("v")).alias("value"), F.coalesce("n_rows", "v_n").alias("n_tested"), all_nn.alias("all_nn"))
    wanted = F.col("request.subgroup")
    return classify(v, p.rules).where((wanted == ALL_CONSTRUCTS) | (wanted == F.col("Subgroup"))).drop("Subgroup")


def many_heatmaps(p: Prepared, requests: DataFrame, show_values: bool = True) -> DataFrame:
    """C1 for every request: its dense grid with cell encodings and row breadth, keyed by spec_id."""
    of = lambda name: F.col(f"request.{name}")
    grid = build_grid(many_views(p, requests), of("metric"), of("mode"), of("threshold"), of("ge"), of("bucket"), of("sort_by"), of("sort_descending"),
                      p.rules.target_groups, ["request"], use_genotype=of("use_genotype"))
    drawn = encode_cells(grid, of("metric"), of("mode"), show_values).withColumn("breadth_label", breadth_label("n_positive", "n_tested_targets"))
    return drawn.withColumn("spec_id", of("spec_id")).drop("request")
