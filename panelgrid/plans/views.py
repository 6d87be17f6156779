"""Composite plans: single view (C1), small multiples (C2), top-N summary
(C5), dose-response curves with fits — each one lazy DataFrame plan.

All of them read the cube (``operators.cube``), not the tidy rows.
Subgroups are attached to the aggregated view rows (a subgroup is a function
of the construct), so the subgroup filter (F6) and the per-subgroup split run
after the partial aggregation instead of on raw rows.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ALL_CONSTRUCTS, TOP_N, ViewSpec
from ..operators.classify import classify
from ..operators.cube import cube_curves, cube_view
from ..operators.grid import build_grid, encode_cells
from ..operators.prepare import Prepared
from ..operators.topn import match_panel, top_constructs
from ..operators.view import resolve_dilution, subgroup_filter, view_filter
from ..session import kept

C, T = "Construct_Description", "PSV"


def filtered(p: Prepared, spec: ViewSpec) -> DataFrame:
    """the cube's rows in the request's experiment / target / group selection."""
    return view_filter(p.cube, spec)


def spec_view(p: Prepared, spec: ViewSpec, cube: Optional[DataFrame] = None,
              with_subgroup: bool = False) -> DataFrame:
    """The view of the selected cube rows, with the dose resolved (F13) and, when
    needed, the subgroup attached and filtered (F6)."""
    f = filtered(p, spec) if cube is None else cube
    v = cube_view(f, spec.metric, resolve_dilution(p.cube, spec), p.rules.buckets)
    if with_subgroup or spec.subgroup != ALL_CONSTRUCTS:
        v = subgroup_filter(classify(v, p.rules), spec.subgroup)
    return v


def _grid(view: DataFrame, p: Prepared, spec: ViewSpec, keys: Sequence[str] = (),
          target_order: Optional[DataFrame] = None, genotypes=True) -> DataFrame:
    geno = p.rules.target_groups if (spec.use_genotype and genotypes) else None
    return build_grid(view, spec.metric, spec.mode, spec.threshold, spec.ge, spec.bucket,
                      spec.sort_by, spec.sort_descending, geno, keys, target_order=target_order)


def heatmap(p: Prepared, spec: ViewSpec, show_values: bool = True) -> DataFrame:
    """One dense grid with cell encodings."""
    grid = _grid(spec_view(p, spec), p, spec)
    return encode_cells(grid, spec.metric, spec.mode, show_values)


def small_multiples(p: Prepared, spec: ViewSpec, show_values: bool = True) -> DataFrame:
    """One grid per present subgroup, in a single plan keyed by subgroup;
    empty subgroups simply produce no rows.  If no construct of the data is in a
    listed subgroup, there is one grid of all constructs."""
    v = spec_view(p, spec, with_subgroup=True)
    listed = list(p.rules.subgroup_order)
    in_list = F.col("Subgroup").isin(*listed) if listed else F.lit(False)
    any_listed = classify(p.cube.select(C).distinct(), p.rules).agg(
        F.coalesce(F.max(in_list), F.lit(False)).alias("any_listed")).scalar()
    v = v.filter(in_list | ~any_listed).withColumn(
        "Subgroup", F.when(any_listed, F.col("Subgroup")).otherwise(F.lit(ALL_CONSTRUCTS)))
    grid = _grid(v, p, spec, keys=["Subgroup"])
    return encode_cells(grid, spec.metric, spec.mode, show_values)


def top_summary(p: Prepared, spec: ViewSpec, panel: Sequence[str], n: int = TOP_N,
                show_values: bool = True) -> DataFrame:
    """Panel targets matched on the unfiltered targets (G33), top ``n``
    constructs per subgroup scored over all buckets (G27, G28), then one grid
    per subgroup densified to the panel in panel order (J8)."""
    matched = kept(match_panel(p.cube, panel))
    f_panel = filtered(p, spec).join(matched.select(T), T, "left_semi")
    v_panel = kept(cube_view(f_panel, spec.metric, resolve_dilution(p.cube, spec), p.rules.buckets))
    top = top_constructs(f_panel, v_panel, p.rules, n)
    top = subgroup_filter(top, spec.subgroup)
    listed = list(p.rules.subgroup_order)
    top = top.filter(F.col("Subgroup").isin(*listed))
    v_top = v_panel.join(top.select(C, "Subgroup"), C, "inner")  # J11 (top rows: bounded)
    grid = _grid(v_top, p, spec, keys=["Subgroup"], target_order=matched, genotypes=False)
    return encode_cells(grid, spec.metric, spec.mode, show_values)


def curve_table(p: Prepared, spec: ViewSpec, construct: Optional[str] = None,
                target: Optional[str] = None) -> DataFrame:
    """Curves after the request filters (no subgroup filter, as for the curve
    endpoint); with a bucket only that bucket's rows."""
    f = filtered(p, spec)
    if construct is not None:
        f = f.where(F.col(C) == construct)
    if target is not None:
        f = f.where(F.col(T) == target)
    return cube_curves(f.where(F.col("Bucket_Type") == spec.bucket) if spec.bucket else f)
