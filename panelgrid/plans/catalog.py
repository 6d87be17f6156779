"""Registered queries: one per operator group of the inventory.

Each callable takes ``(spark, sf_dir)``, reads the driver tables through the
assay adapter and returns a DataFrame (nothing is collected here).  Doubles
are rounded to 6 decimals and array outputs are summarised (size, sum) so
that results compare exactly with the SQL twins in ``oracle``.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ALL_CONSTRUCTS, FIT_BOTTOM_BOUNDS, FIT_IC50_FACTORS, FIT_SLOPE_BOUNDS, FIT_TOP_BOUNDS, ViewSpec
from ..functions.arrays import array_text, parse_array_text, value_at_dose
from ..functions.hill import hill4pl, logspace_points
from ..functions.numeric import day_int, parse_potency_variant
from ..functions.status import view_title
from ..operators.classify import classified_constructs, with_subgroup
from ..operators.cube import build_cube, cube_curves, cube_view, default_dose
from ..operators.diagnostics import counters, domains, grid_sizes
from ..operators.export import export_long, write_export
from ..operators.fit import fit_curves, fit_lines, grid_errors
from ..operators.grid import build_grid, cell_statuses, pivot_wide, unpivot_long
from ..operators.prepare import (Prepared, build_lookup, cohort_filters, prepare,
                                 resolve_descriptions, tidy_projection)
from ..operators.ranking import ordered_rank
from ..operators.topn import match_panel, top_constructs
from ..session import release_kept, passing_path
from ..sources.assay import ASSAY_TABLES, DEMO_PANEL, constructs_sheet, demo_rules, measurement_sheet, part_rules
from ..sources.store import TableStore, listing_hash, rules_hash
from ..sources.sheets import read_sheet, resolve_columns, scan_sheets, select_resolved, write_sheet
from . import views
from .requests import many_heatmaps, request_table

C, T = "Construct_Description", "PSV"

# Specs used by the registered queries.
SPEC_SINGLE = ViewSpec(metric="pct_neut", dilution=None, mode="threshold", threshold=50.0, ge=True)
SPEC_RANKED = ViewSpec(metric="log10_ic50", mode="gradient", threshold=3.0, bucket="Boost1",
                       sort_by="mean_value", sort_descending=False)
SPEC_FILTERED = ViewSpec(metric="pct_neut", dilution=30.0, experiments=("1-URGENT", "2-HIGH"),
                         targets=tuple(f"NATION_{i}" for i in range(0, 25, 2)), groups=("F",),
                         subgroup="2. Widgets")
SPEC_MULTI = ViewSpec(metric="pct_neut", dilution=30.0, mode="threshold", threshold=50.0,
                      use_genotype=True)
SPEC_TOP = ViewSpec(metric="pct_neut", dilution=90.0, mode="threshold", threshold=50.0)
SPEC_CURVE = ViewSpec(metric="pct_neut", threshold=75.0, bucket="Boost1")

#: Requests of one plan: presets of both metrics, every kind of dose, selection and order.
REQUESTS = {
    "01 default": ViewSpec.for_metric("pct_neut", mode="threshold"),
    "02 second preset": ViewSpec.for_metric("pct_neut", preset=1, mode="threshold", ge=False, bucket="Prime", dilution=30.0),
    "03 potency": ViewSpec.for_metric("log10_ic50", sort_by="mean_value", sort_descending=False, use_genotype=True),
    "04 potency preset": ViewSpec.for_metric("log10_ic50", preset=1, mode="threshold", bucket="Boost2"),
    "05 all doses": ViewSpec(dilution="all", sort_by="mean_value"),
    "06 lists": ViewSpec(dilution=90.0, experiments=("1-URGENT", "2-HIGH", "2-HIGH"), groups=("F",), targets=("NATION_3", "NATION_4", "NATION_8", "nobody")),
    "07 subgroup": ViewSpec(dilution=10.0, subgroup="2. Widgets", use_genotype=True, sort_descending=False),
    "08 none chosen": ViewSpec(dilution=30.0, experiments=(), empty_is_none=True),
    "09 groups unfiltered": ViewSpec(dilution=30.0, groups=(), empty_is_none=True, bucket="Boost1"),
    "10 blank groups too": ViewSpec(metric="log10_ic50", default_group_filter=False, mode="threshold", threshold=None, ge=None),
    "11 absent dose": ViewSpec(dilution=7.0),
    "12 one experiment": ViewSpec(dilution=270.0, experiments=("3-MEDIUM",), bucket="All"),
}

_PREPARED: dict = {}


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def prepared(spark: SparkSession, sf_dir: str, corrected: bool = True) -> Prepared:
    """The prepared sheet (S8): tidy rows and their cube are made once for each
    state of the input files and rules, and stored; every view reads the cube."""
    rules = demo_rules()
    manifest = {"inputs": listing_hash(spark, [f"{sf_dir}/{t}.parquet" for t in ASSAY_TABLES]), "rules": rules_hash(rules),
                "measurement": "corrected" if corrected else "raw"}
    key = (spark.sparkContext.applicationId, sf_dir, corrected)
    known = _PREPARED.get(key)
    if known is None or known[0] != manifest:
        p = prepare(measurement_sheet(spark, sf_dir), rules, constructs_sheet(spark, sf_dir), corrected)
        tables = TableStore(spark).fetch("assay", manifest, {"tidy": lambda made: p.tidy, "cube": lambda made: build_cube(made["tidy"])})
        _PREPARED[key] = known = (manifest, replace(p, **tables))
    return known[1]


def release(spark: SparkSession) -> None:
    """Let go of the stored tables and kept intermediates of this session (S8 "clear")."""
    for k in list(_PREPARED):
        if k[0] == spark.sparkContext.applicationId:
            del _PREPARED[k]
    TableStore(spark).clear("assay")
    release_kept(spark)


def _arr_summary(arr: Column, name: str) -> list[Column]:
    return [F.size(arr).cast("bigint").alias(f"n_{name}"),
            F.round(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), 6).alias(f"sum_{name}")]


# --------------------------------------------------------------------------- sources

SHEET_HEADERS = {
    "Sample_Type": " Sample Type ", "Group": "group", "PSVX_No": "PSVX No.", "PSV": "PSV",
    "Day": "Day", "Experiment": "Experiment ID", "Construct_Description": "Construct Description",
    "Dilution": "Dilution", "Avg_Neut_percent_corrected": "Avg_Neut_percent_corrected",
    "IC50_corrected": "IC50_corrected", "IC50": "IC50", "Avg_Neut_percent": "Avg_Neut_percent",
}


def _in_files(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many tasks as a shuffle has, each writing a file: more than one, and more of them as the data grow."""
    return df.repartition(max(3, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def q01_scan_resolve(spark, sf_dir):
    """Write the sheet as CSV with loose headers, read it back as
    text, resolve the column roles."""
    raw = measurement_sheet(spark, sf_dir)
    loose = raw.select(F.col("row_id").cast("string").alias("row_id"),
                       *[F.col(k).alias(v) for k, v in SHEET_HEADERS.items()])
    path = passing_path(spark, "sheet-csv")
    write_sheet(_in_files(loose), path)
    back = read_sheet(spark, path)
    out = select_resolved(back, corrected=True)
    return out.withColumn("row_id", F.col("row_id").cast("bigint"))


def q01b_ragged_sheets(spark, sf_dir):
    """Two folders of ragged sheets, the second named by a prefix of the
    first; rows by first and last mention, and the rejected rows."""
    raw = measurement_sheet(spark, sf_dir)
    base = passing_path(spark, "ragged sheets")
    rest = F.when(F.col("row_id") % 7 == 3, "").when(F.col("row_id") % 11 == 5, F.lit(",beyond,further"))
    line = lambda version: F.concat(F.col("row_id"), F.lit(","), "Group", F.when(F.col("row_id") % 7 == 3, "").otherwise(F.lit(f",{version}")),
                                    F.coalesce(rest, F.lit("")))
    for folder, version, rows in (("part2", "first", raw), ("part", "second", raw.where("row_id % 2 = 0"))):
        # one column whose separator never occurs: lines are written as they are
        (_in_files(rows.select(line(version).alias("id , Group,version"))).write.mode("overwrite")
         .option("header", "true").option("sep", "\u0001").option("ignoreTrailingWhiteSpace", "false").csv(f"{base}/{folder}"))
    scan = scan_sheets(spark, [f"{base}/part2", f"{base}/part"], row_id="place")
    got = scan.rows.groupBy("id", "Group").agg(F.min_by("version", "place").alias("first"), F.max_by("version", "place").alias("last"),
                                               F.count(F.lit(1)).alias("n"))
    cell = lambda k: F.get("cells", F.lit(k))
    rejected = scan.rejects.groupBy(cell(0).alias("id"), cell(1).alias("Group")).agg(
        F.min(cell(2)).alias("first"), F.max(cell(3)).alias("last"), F.count(F.lit(1)).alias("n"))
    return got.select(F.lit("row").alias("kind"), "*").unionByName(rejected.select(F.lit("reject").alias("kind"), "*")).select(
        "kind", F.col("id").cast("bigint").alias("id"), F.col("Group").alias("grp"), "first", "last", "n")


def q02_base_filters(spark, sf_dir):
    """F1-F3 + S6: cohort filters, raw (uncorrected) measurement columns."""
    raw = measurement_sheet(spark, sf_dir)
    cols = resolve_columns(raw.columns, corrected=False)
    return select_resolved(cohort_filters(raw, cols, demo_rules()), corrected=False)


def q03_tidy(spark, sf_dir):
    """The tidy frame with its subgroup."""
    p = prepared(spark, sf_dir)
    t = with_subgroup(p.tidy, p.rules)
    return t.select("row_id", "Experiment", "Group", "PSV", r6("Day").alias("Day"), "PSVX_num",
                    C, "Bucket_Type", "Subgroup", r6("IC50").alias("IC50"), "Is_NN",
                    r6("Log10_IC50").alias("Log10_IC50"),
                    *_arr_summary(F.col("DilutionArray"), "dil"), *_arr_summary(F.col("NeutArray"), "neut"))


def q04_parse_arrays(spark, sf_dir):
    """Array text parsing on every raw row."""
    raw = measurement_sheet(spark, sf_dir)
    src = {"dil": "Dilution", "neut": "Avg_Neut_percent_corrected", "neut_raw": "Avg_Neut_percent"}
    texts = raw.select("row_id", *[array_text(c).alias(k) for k, c in src.items()])
    arrays = texts.select("row_id", *[parse_array_text(k).alias(k) for k in src])
    return arrays.select("row_id", *[x for k in src for x in _arr_summary(F.col(k), k)])


def q04b_potency_variant(spark, sf_dir):
    """The other reading of potency texts, on every raw row."""
    raw = measurement_sheet(spark, sf_dir)
    got = raw.select("row_id", parse_potency_variant("IC50").alias("p"))
    return got.select("row_id", r6("p.log10").alias("log10"), F.col("p.is_nn").alias("is_nn"))


def q05_value_at_dose(spark, sf_dir):
    """First response within the dose tolerance."""
    t = prepared(spark, sf_dir).tidy
    d, n = F.col("DilutionArray"), F.col("NeutArray")
    return t.select("row_id", *[r6(value_at_dose(d, n, x)).alias(nm) for nm, x in
                                (("v30", 30.0), ("v30_009", 30.009), ("v30_02", 30.02),
                                 ("v90", 90.0), ("v7290", 7290.0))])


def q06_build_lookup(spark, sf_dir):
    """Description lookup (pairs and cohort fallbacks)."""
    pair, fb = build_lookup(constructs_sheet(spark, sf_dir), demo_rules())
    return (pair.select(F.lit("pair").alias("kind"), F.col("lk_psvx").alias("psvx"),
                        F.col("lk_grp").alias("grp"), F.col("pair_desc").alias("description"))
            .unionByName(fb.select(F.lit("fallback").alias("kind"), F.col("fb_psvx").alias("psvx"),
                                   F.lit("").alias("grp"), F.col("fb_desc").alias("description"))))


def q07_resolve_description(spark, sf_dir):
    """Two-level description lookup before bucketing."""
    raw = measurement_sheet(spark, sf_dir)
    rules = demo_rules()
    cols = resolve_columns(raw.columns)
    t = tidy_projection(cohort_filters(raw, cols, rules), cols)
    t = resolve_descriptions(t, build_lookup(constructs_sheet(spark, sf_dir), rules), rules)
    return t.select("row_id", "PSVX_num", "Group", C)


def q08_bucket_override(spark, sf_dir):
    """Dose window and label overrides."""
    t = prepared(spark, sf_dir).tidy
    return t.select("row_id", "Experiment", r6("Day").alias("Day"), day_int(F.col("Day")).alias("day_int"),
                    "Bucket_Type", C)


def q09_classify(spark, sf_dir):
    """Subgroup of every distinct construct."""
    p = prepared(spark, sf_dir)
    return classified_constructs(p.cube, p.rules).select(C, "Subgroup", F.col("n_rows").cast("bigint"))


def q09b_classify_rule_table(spark, sf_dir):
    """J5 with a rule table that grows with the data (one rule a part)."""
    p = prepared(spark, sf_dir)
    rules = replace(p.rules, pattern_rules=part_rules(spark, sf_dir))
    return classified_constructs(p.cube, rules).select(C, "Subgroup", F.col("n_rows").cast("bigint"))


def _view_out(v: DataFrame) -> DataFrame:
    return v.select("Bucket_Type", C, T, r6("value").alias("value"),
                    F.col("n_tested").cast("bigint").alias("n_tested"), "all_nn")


def q10_view_single_dose(spark, sf_dir):
    """% response at the default dose."""
    p = prepared(spark, sf_dir)
    return _view_out(cube_view(p.cube, "pct_neut", default_dose(p.cube), p.rules.buckets))


def q11_view_all_doses(spark, sf_dir):
    """A2, X11: % response over all dose pairs."""
    p = prepared(spark, sf_dir)
    return _view_out(cube_view(p.cube, "pct_neut", "all", p.rules.buckets))


def q12_view_log10(spark, sf_dir):
    """A3: log10 potency mean, counts, all-NN flag."""
    p = prepared(spark, sf_dir)
    return _view_out(cube_view(p.cube, "log10_ic50", None, p.rules.buckets))


def q13_cell_status(spark, sf_dir):
    """statuses per view row (threshold 75, strict >)."""
    p = prepared(spark, sf_dir)
    v = cube_view(p.cube, "pct_neut", 30.0, p.rules.buckets)
    s = cell_statuses(v, "pct_neut", "threshold", 75.0, False)
    return s.select("Bucket_Type", C, T, r6("value").alias("value"), "status")


def q14_view_filters(spark, sf_dir):
    """experiment / target / group selection and subgroup filter."""
    p = prepared(spark, sf_dir)
    v = views.spec_view(p, SPEC_FILTERED)
    return v.select("Bucket_Type", C, T, r6("value").alias("value"),
                    F.col("n_tested").cast("bigint").alias("n_tested"), "all_nn", "Subgroup")


def q14b_many_requests(spark, sf_dir):
    """Twelve requests as one plan."""
    p = prepared(spark, sf_dir)
    g = many_heatmaps(p, request_table(spark, REQUESTS))
    return g.select(*_grid_cols(["spec_id"]), r6("z").alias("z"), "label", "breadth_label")


def _grid_cols(keys=()) -> list:
    return [*keys, C, T, r6("value").alias("value"), "status", "n_tested",
            r6("row_breadth").alias("row_breadth"), r6("row_mean").alias("row_mean"),
            "export_rank", "row_rank", "col_rank", r6("col_breadth").alias("col_breadth"), "genotype"]


def _grid_out(g: DataFrame, keys=()) -> DataFrame:
    return g.select(*_grid_cols(keys))


def grid_q15(spark, sf_dir) -> DataFrame:
    p = prepared(spark, sf_dir)
    v = cube_view(p.cube, "pct_neut", 90.0, p.rules.buckets)
    return build_grid(v, "pct_neut", "threshold", 50.0, True)


def q15_grid(spark, sf_dir):
    """Pooled dense grid."""
    return _grid_out(grid_q15(spark, sf_dir))


def q16_grid_rows_ranked(spark, sf_dir):
    """One bucket, log10 gradient, mean order ascending."""
    p = prepared(spark, sf_dir)
    g = views.heatmap(p, SPEC_RANKED)
    return g.select(*_grid_cols(), r6("z").alias("z"), "label")


def q17_small_multiples(spark, sf_dir):
    """One grid per subgroup, genotype column order."""
    p = prepared(spark, sf_dir)
    return _grid_out(views.small_multiples(p, SPEC_MULTI), ["Subgroup"])


def q18_panel_match(spark, sf_dir):
    """Panel targets matched exactly or by substring."""
    return match_panel(prepared(spark, sf_dir).cube, DEMO_PANEL)


def q19_top_n(spark, sf_dir):
    """Top 4 constructs per subgroup on the panel targets."""
    p = prepared(spark, sf_dir)
    f = views.filtered(p, SPEC_TOP).join(match_panel(p.cube, DEMO_PANEL).select(T), T, "left_semi")
    v = cube_view(f, "pct_neut", 90.0, p.rules.buckets)
    top = top_constructs(f, v, p.rules, 4)
    return top.select("Subgroup", C, F.col("n_positive").cast("bigint"), r6("total").alias("total"),
                      F.col("top_rank").cast("bigint"))


def q20_top_summary(spark, sf_dir):
    """Top-4 grids densified to the panel, panel column order."""
    p = prepared(spark, sf_dir)
    g = views.top_summary(p, SPEC_TOP, DEMO_PANEL)
    return g.select("Subgroup", C, T, r6("value").alias("value"), "status", "export_rank", "row_rank",
                    "col_rank")


def q21_curve(spark, sf_dir):
    """Mean response per dose for every pair."""
    p = prepared(spark, sf_dir)
    c = cube_curves(p.cube)
    return c.select(C, T, r6("dilution").alias("dilution"), r6("pct_neut").alias("pct_neut"),
                    F.col("n_obs").cast("bigint"))


def q21b_curve_request(spark, sf_dir):
    """The curves of one target and bucket, their dose order and
    the threshold line."""
    p = prepared(spark, sf_dir)
    c = views.curve_table(p, SPEC_CURVE, target="NATION_3")
    by_dose = Window.partitionBy(C, T).orderBy("dilution")
    return c.select(C, T, r6("dilution").alias("dilution"), r6("pct_neut").alias("pct_neut"),
                    F.row_number().over(by_dose).cast("bigint").alias("dose_rank"),
                    F.lit(SPEC_CURVE.curve_threshold()).alias("threshold"))


def q22_diagnostics(spark, sf_dir):
    """Counters and the single-view title."""
    p = prepared(spark, sf_dir)
    title = view_title(ALL_CONSTRUCTS, None, "pct_neut", default_dose(p.cube), "threshold", 50.0)
    return counters(p).withColumn("title", title)


def q22b_grid_sizes(spark, sf_dir):
    """Grid size and title per small multiple."""
    p = prepared(spark, sf_dir)
    g = grid_sizes(views.small_multiples(p, SPEC_MULTI))
    return g.select("Subgroup", F.col("n_constructs").cast("bigint"), F.col("n_targets").cast("bigint"),
                    "title")


def q23_domains(spark, sf_dir):
    """Value domains in long form."""
    return domains(prepared(spark, sf_dir))


def q24_export_long(spark, sf_dir):
    """Long export of the pooled grid."""
    e = export_long(grid_q15(spark, sf_dir))
    return e.select(C, T, r6("value").alias("value"), "status", "export_seq")


def q24b_export_file(spark, sf_dir):
    """The export written as CSV and read back, with each row's place in the files."""
    path = passing_path(spark, "export-csv")
    write_export(export_long(grid_q15(spark, sf_dir)), path)
    back = read_sheet(spark, path, multi_line=True)  # labels may hold line ends
    placed = ordered_rank(back, [], [F.col("row_id")], rank_col="file_place")
    return placed.select(C, T, r6(F.nullif(F.col("value"), F.lit("")).cast("double")).alias("value"), "status",
                         F.col("export_seq").cast("bigint").alias("export_seq"), F.col("file_place").cast("bigint").alias("file_place"))


def q25_pivot_wide(spark, sf_dir):
    """Value matrix, one column per target."""
    g = grid_q15(spark, sf_dir).withColumn("value", r6("value"))
    return pivot_wide(g)


def q26_unpivot(spark, sf_dir):
    """The value matrix back to long rows."""
    g = grid_q15(spark, sf_dir).withColumn("value", r6("value"))
    return unpivot_long(pivot_wide(g), [C, "export_rank"])


def q27_fit_4pl(spark, sf_dir):
    """4PL fit per pair (grouped map over the aggregated curves)."""
    p = prepared(spark, sf_dir)
    return fit_curves(cube_curves(p.cube))


def q27b_fit_bounded(spark, sf_dir):
    """The better of the fits from the usual start and from the best node of a
    fixed grid; status, doses, the grid's least error, and whether the fit keeps to
    its bounds and to that error."""
    c = cube_curves(prepared(spark, sf_dir).cube)
    nodes = grid_errors(c)
    f = fit_curves(c, nodes=nodes).join(nodes.select(C, T, "grid_sse"), [C, T], "left")
    ok, near = F.col("fit_status") == "ok", 1 + 1e-9
    inside = (F.col("top").between(*FIT_TOP_BOUNDS) & F.col("bottom").between(*FIT_BOTTOM_BOUNDS) & F.col("slope").between(*FIT_SLOPE_BOUNDS)
              & F.col("ic50").between(F.col("x_min") * FIT_IC50_FACTORS[0] / near, F.col("x_max") * FIT_IC50_FACTORS[1] * near))
    return f.select(C, T, "n_points", r6("x_min").alias("x_min"), r6("x_max").alias("x_max"), "fit_status", F.round("grid_sse", 2).alias("grid_sse"),
                    F.when(ok, inside).alias("in_bounds"), F.when(ok, F.col("sse") <= F.col("grid_sse") * near + 1e-9).alias("not_above_grid"))


def q28_fit_line(spark, sf_dir):
    """Fitted lines and IC50 markers."""
    p = prepared(spark, sf_dir)
    return fit_lines(fit_curves(cube_curves(p.cube)))


def q29_hill_fixed(spark, sf_dir):
    """X12, X13 with fixed parameters (top 100, bottom 0, ic50 300, slope 1)
    on each pair's dose span."""
    p = prepared(spark, sf_dir)
    c = cube_curves(p.cube).groupBy(C, T).agg(F.min("dilution").alias("lo"), F.max("dilution").alias("hi"))
    pts = c.select(C, T, F.posexplode(logspace_points(F.col("lo") * 0.5, F.col("hi") * 2.0, 300))
                   .alias("point", "x"))
    return pts.select(C, T, F.col("point").cast("bigint"), F.round("x", 4).alias("x"),
                      F.round(hill4pl("x", 100.0, 0.0, 300.0, 1.0), 4).alias("y"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: fn for name, fn in sorted(globals().items()) if name[:1] == "q" and name[1:3].isdigit()
}
