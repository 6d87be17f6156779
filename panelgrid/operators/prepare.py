"""Sheet → tidy frame (C6): cohort filters (F1-F3), tidy projection (F4),
description lookup (J1, J2), dose-window map (J3), label overrides (J6).

Every step is a narrow projection or a join against a small, size-checked
broadcast dimension, so the raw rows are never shuffled here.  The subgroup
is *not* computed per row: it is a function of the construct text and is
attached to aggregated rows (see ``classify``).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import UNKNOWN_BUCKET, Rules
from ..functions.arrays import array_text, parse_array_text
from ..functions.numeric import day_int, day_number, is_nn, log10_pos, to_float
from ..functions.text import as_text, cohort_id, cohort_key, ustrip
from ..session import bounded_broadcast, rows_df
from .cube import build_cube
from ..sources.sheets import SheetColumns, resolve_columns, resolve_construct_columns

TIDY_COLUMNS = ["row_id", "Experiment", "Group", "PSV", "Day", "PSVX_num", "Construct_Description",
                "Bucket_Type", "IC50", "Is_NN", "Log10_IC50", "DilutionArray", "NeutArray"]


@dataclass
class Prepared:
    tidy: DataFrame
    raw: DataFrame
    filtered_raw: DataFrame
    columns: SheetColumns
    rules: Rules
    cube: Optional[DataFrame] = None

    def __post_init__(self):
        if self.cube is None:
            self.cube = build_cube(self.tidy)


def _col(name: Optional[str]):
    return F.col(f"`{name}`") if name else None


def cohort_filters(raw: DataFrame, cols: SheetColumns, rules: Rules) -> DataFrame:
    """F1 drop sample types (strip + lower), F2 drop groups (strip, case
    sensitive), F3 keep experiments (strip).  A filter whose column is absent
    is skipped."""
    df = raw
    if cols.sample and rules.drop_sample_types:
        df = df.filter(~F.lower(ustrip(as_text(_col(cols.sample)))).isin(*rules.drop_sample_types))
    if cols.group and rules.drop_groups:
        df = df.filter(~ustrip(as_text(_col(cols.group))).isin(*rules.drop_groups))
    if cols.experiment and rules.keep_experiments is not None:
        df = df.filter(ustrip(as_text(_col(cols.experiment))).isin(*rules.keep_experiments))
    return df


def tidy_projection(df: DataFrame, cols: SheetColumns) -> DataFrame:
    """standard columns, literals for absent ones."""
    def text(name):
        return ustrip(as_text(_col(name))) if name else F.lit("")

    empty = F.array().cast("array<double>")
    ic50 = to_float(_col(cols.ic50)) if cols.ic50 else F.lit(None).cast("double")
    rid = F.col("row_id") if "row_id" in df.columns else F.monotonically_increasing_id()
    # array texts are normalised in their own projection (each used twice below)
    df = df.select("*", (array_text(_col(cols.dilution)) if cols.dilution else F.lit("")).alias("_dil_txt"),
                   (array_text(_col(cols.neut)) if cols.neut else F.lit("")).alias("_neut_txt"))
    return df.select(
        rid.alias("row_id"),
        text(cols.experiment).alias("Experiment"),
        text(cols.group).alias("Group"),
        text(cols.psv).alias("PSV"),
        (day_number(_col(cols.day)) if cols.day else F.lit(None).cast("double")).alias("Day"),
        (cohort_id(as_text(_col(cols.psvx))) if cols.psvx else F.lit("")).alias("PSVX_num"),
        text(cols.desc).alias("Construct_Description"),
        (parse_array_text(F.col("_dil_txt")) if cols.dilution else empty).alias("DilutionArray"),
        (parse_array_text(F.col("_neut_txt")) if cols.neut else empty).alias("NeutArray"),
        (is_nn(_col(cols.ic50)) if cols.ic50 else F.lit(False)).alias("Is_NN"),
        ic50.alias("IC50"),
    ).withColumn("Log10_IC50", log10_pos(F.col("IC50")))


def build_lookup(constructs: DataFrame, rules: Rules):
    """(cohort, group) → description, last row wins; and cohort → fallback
    description: the last blank-group row if any, else the first row.

    Returns ``(pair_dim, fallback_dim)`` or ``None`` when the sheet lacks a
    needed column.  ``row_id`` gives the row order.
    """
    cc = resolve_construct_columns(constructs.columns)
    if not (cc["psvx"] and cc["group"] and cc["desc"]):
        return None
    df = constructs
    if cc["program"] and rules.program is not None:
        df = df.filter(F.upper(ustrip(as_text(_col(cc["program"])))) == rules.program.upper())
    rid = F.col("row_id") if "row_id" in df.columns else F.monotonically_increasing_id()
    rows = df.select(
        rid.alias("rid"),
        cohort_key(as_text(_col(cc["psvx"]))).alias("lk_psvx"),
        ustrip(as_text(_col(cc["group"]))).alias("lk_grp"),
        ustrip(as_text(_col(cc["desc"]))).alias("lk_desc"),
    ).filter((F.col("lk_psvx") != "") & (F.col("lk_desc") != "")
             & ~F.lower(F.col("lk_desc")).isin("nan", "none", ""))
    pair = (rows.filter(F.col("lk_grp") != "").groupBy("lk_psvx", "lk_grp")
            .agg(F.max_by("lk_desc", "rid").alias("pair_desc")))
    blank_rid = F.when(F.col("lk_grp") == "", F.col("rid"))
    fallback = (rows.groupBy(F.col("lk_psvx").alias("fb_psvx"))
                .agg(F.coalesce(F.max_by("lk_desc", blank_rid), F.min_by("lk_desc", "rid"))
                     .alias("fb_desc")))
    return pair, fallback


def resolve_descriptions(tidy: DataFrame, lookup, rules: Rules) -> DataFrame:
    """(cohort, group) → (cohort) → own description; two left joins
    against size-checked broadcast dimensions."""
    if lookup is None:
        return tidy
    pair, fallback = lookup
    pair = bounded_broadcast(pair, rules.max_broadcast_rows)
    fallback = bounded_broadcast(fallback, rules.max_broadcast_rows)
    key = F.upper(F.col("PSVX_num"))
    df = tidy.join(pair, (key == pair["lk_psvx"]) & (F.col("Group") == pair["lk_grp"]), "left")
    df = df.join(fallback, key == fallback["fb_psvx"], "left")
    desc = F.coalesce(F.col("pair_desc"), F.col("fb_desc"), F.col("Construct_Description"))
    return df.withColumn("Construct_Description", desc).drop(
        "lk_psvx", "lk_grp", "pair_desc", "fb_psvx", "fb_desc")


def _last_wins(rows, nkey: int) -> list[tuple]:
    d = {}
    for r in rows:
        d[tuple(r[:nkey])] = tuple(r)
    return list(d.values())


def bucket_dim(spark, rules: Rules) -> DataFrame:
    bm = rules.bucket_map
    schema = "bm_exp string, bm_psvx string, bm_day bigint, bm_bucket string"
    if isinstance(bm, DataFrame):
        dim = bm.select(F.col("experiment").alias("bm_exp"), F.col("psvx").cast("string").alias("bm_psvx"),
                        F.col("day").cast("bigint").alias("bm_day"), F.col("bucket").alias("bm_bucket"))
        return bounded_broadcast(dim, rules.max_broadcast_rows)
    rows = [(str(e), str(p), int(d), str(b)) for e, p, d, b in _last_wins(bm, 3)]
    dim = rows_df(spark, rows, schema)
    return F.broadcast(dim) if len(rows) <= rules.max_broadcast_rows else dim


def assign_buckets(tidy: DataFrame, rules: Rules) -> DataFrame:
    """J3 + X9: (experiment, cohort, int(day)) → bucket, else Unknown."""
    dim = bucket_dim(tidy.sparkSession, rules)
    cond = ((F.col("Experiment") == dim["bm_exp"]) & (F.col("PSVX_num") == dim["bm_psvx"])
            & (day_int(F.col("Day")) == dim["bm_day"]))
    df = tidy.join(dim, cond, "left")
    return df.withColumn("Bucket_Type", F.coalesce(F.col("bm_bucket"), F.lit(UNKNOWN_BUCKET))) \
        .drop("bm_exp", "bm_psvx", "bm_day", "bm_bucket")


def override_dim(spark, rules: Rules) -> DataFrame:
    lo = rules.label_overrides
    schema = "ov_exp string, ov_grp string, ov_bucket string, ov_label string"
    if isinstance(lo, DataFrame):
        dim = lo.select(F.col("experiment").alias("ov_exp"), F.col("group").alias("ov_grp"),
                        F.col("bucket").alias("ov_bucket"), F.col("label").alias("ov_label"))
        return bounded_broadcast(dim, rules.max_broadcast_rows)
    rows = _last_wins(lo, 3)
    dim = rows_df(spark, rows, schema)
    return F.broadcast(dim) if len(rows) <= rules.max_broadcast_rows else dim


def apply_overrides(tidy: DataFrame, rules: Rules) -> DataFrame:
    """Relabel by (experiment, group, bucket) after bucketing."""
    if not isinstance(rules.label_overrides, DataFrame) and not rules.label_overrides:
        return tidy
    dim = override_dim(tidy.sparkSession, rules)
    cond = ((F.col("Experiment") == dim["ov_exp"]) & (F.col("Group") == dim["ov_grp"])
            & (F.col("Bucket_Type") == dim["ov_bucket"]))
    df = tidy.join(dim, cond, "left")
    return df.withColumn("Construct_Description",
                         F.coalesce(F.col("ov_label"), F.col("Construct_Description"))) \
        .drop("ov_exp", "ov_grp", "ov_bucket", "ov_label")


def prepare(raw: DataFrame, rules: Rules, constructs: Optional[DataFrame] = None,
            corrected: bool = True) -> Prepared:
    """The whole prepare pipeline (lazy; nothing runs until an action)."""
    cols = resolve_columns([c for c in raw.columns if c != "row_id"], corrected)
    filtered = cohort_filters(raw, cols, rules)
    tidy = tidy_projection(filtered, cols)
    if constructs is not None:
        tidy = resolve_descriptions(tidy, build_lookup(constructs, rules), rules)
    tidy = assign_buckets(tidy, rules)
    tidy = apply_overrides(tidy, rules)
    return Prepared(tidy=tidy.select(*TIDY_COLUMNS), raw=raw, filtered_raw=filtered,
                    columns=cols, rules=rules)
