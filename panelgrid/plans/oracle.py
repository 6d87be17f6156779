"""SQL twins of the registered queries, written for DuckDB over the driver
tables (``region nation customer supplier part orders lineitem ...`` views).

They restate the same semantics independently in SQL (the adapter, the
prepare pipeline, views, grids, top-N, curves) so that the Spark plans can
be checked value by value.  Rule tables are inlined as VALUES from the same
configuration the Spark side uses.
"""

from __future__ import annotations

from ..config import FIT_BOTTOM_BOUNDS, FIT_MIN_POINTS, FIT_TOP_BOUNDS, NN_TOKENS, NN_TOKENS_VARIANT
from ..functions.arrays import NP_WRAP_RE
from ..functions.numeric import NUMBER_RE
from ..operators.fit import GRID_IC50, GRID_SLOPES
from ..sources.assay import (DEMO_EXACT, DEMO_GENOTYPES, DEMO_OVERRIDES, DEMO_PANEL, DEMO_PATTERNS, PART_PATTERN,
                             PRIORITIES, demo_bucket_map, demo_rules)

RULES = demo_rules()
BUCKETS = RULES.buckets
ORD = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice")

# The grammar of array texts as one pattern: DuckDB's matcher needs no stack for it.
_E = r"(?:[+-]\s*)?(?:\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|0+|[1-9]\d*)"
ARRAY_TEXT_RE = "^(?:" + "|".join(p.replace("E", _E, 9) for p in (
    r"\[\s*(?:E(?:\s*,\s*E)*\s*,?\s*)?\]", r"\(\s*(?:E\s*,\s*(?:E(?:\s*,\s*E)*\s*,?\s*)?)?\)",
    r"E\s*,\s*(?:E(?:\s*,\s*E)*\s*,?)?")) + ")$"



def q(s: str) -> str:
    """SQL string literal."""
    return "'" + str(s).replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def txt(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def parse_number(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN regexp_matches({s}, {q(NUMBER_RE)}) THEN TRY_CAST({s} AS DOUBLE) END)"


def to_float(x: str) -> str:
    return parse_number(f"regexp_replace({strip(txt(x))}, ',', '', 'g')")


def is_nn(x: str) -> str:
    toks = ", ".join(q(t) for t in NN_TOKENS)
    return f"(lower({strip(txt(x))}) IN ({toks}) OR coalesce({to_float(x)} = 0.0, false))"


def parse_array(x: str) -> str:
    s = f"regexp_replace({strip(txt(x))}, {q(NP_WRAP_RE)}, '\\1', 'g')"
    body = rf"regexp_replace({s}, '[\[\]()]', '', 'g')"
    parts = (f"list_filter(list_transform(string_split({body}, ','), lambda t: "
             rf"regexp_replace(t, '\s+', '', 'g')), lambda t: t <> '')")
    nums = f"list_transform({parts}, lambda t: TRY_CAST(t AS DOUBLE))"
    return (f"(CASE WHEN regexp_matches({s}, {q(ARRAY_TEXT_RE)}) AND "
            f"coalesce(list_bool_and(list_transform({nums}, lambda v: v IS NOT NULL)), true) "
            f"THEN {nums} ELSE []::DOUBLE[] END)")


def cohort_id(x: str) -> str:
    s = f"regexp_replace({strip(txt(x))}, '(?i)psvx-?', '', 'g')"
    s = rf"regexp_replace({s}, '\s*\([CRrc]\)\s*', '', 'g')"
    return strip(s)


def norm_name(x: str) -> str:
    s = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    s = f"lower({strip(s)})"
    s = rf"regexp_replace({s}, '\s+_', '_', 'g')"
    return rf"regexp_replace({s}, '_\s+', '_', 'g')"


def value_at(d: str, n: str, dose: str) -> str:
    return (f"(CASE WHEN len({d}) > 0 AND len({d}) = len({n}) THEN "
            f"list_filter(list_zip({d}, {n}), lambda p: abs(p[1] - {dose}) < 0.01)[1][2] END)")


def xsum(x: str) -> str:
    """The exact sum of ``functions.exact``: whole limbs are added, then joined by one formula."""
    f = f"(({x}) - floor({x})) * 1073741824::DOUBLE"
    limb = lambda v: f"sum(CAST(floor({v}) AS BIGINT))::DOUBLE"
    return f"({limb(x)} + ({limb(f)} + {limb(f'({f} - floor({f})) * 1073741824::DOUBLE')} / 1073741824::DOUBLE) / 1073741824::DOUBLE)"


def xavg(x: str) -> str:
    return f"({xsum(x)} / count({x}))"


def arr_text(a: str, np_wrap: str | None = None, as_tuple: str | None = None) -> str:
    elems = f"list_transform({a}, lambda x: CAST(x AS VARCHAR))"
    if np_wrap:
        elems = (f"(CASE WHEN {np_wrap} THEN list_transform({elems}, lambda s: 'np.float64(' || s || ')') "
                 f"ELSE {elems} END)")
    body = f"array_to_string({elems}, ', ')"
    listed = f"'[' || {body} || ']'"
    if as_tuple:
        return f"(CASE WHEN {as_tuple} THEN '(' || {body} || ',)' ELSE {listed} END)"
    return f"({listed})"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


def classify_expr(col: str) -> str:
    parts = [f"WHEN ex.exact_subgroup IS NOT NULL AND ex.exact_subgroup <> '' THEN ex.exact_subgroup"]
    for pat, sg in DEMO_PATTERNS:
        parts.append(f"WHEN regexp_matches({strip(col)}, {q('(?i)' + pat)}) THEN {q(sg)}")
    return "CASE " + " ".join(parts) + f" ELSE {q(RULES.uncategorized)} END"


def classify_join(src: str, col: str) -> str:
    """SELECT src.*, Subgroup FROM src joined with the exact map."""
    return (f"SELECT s.*, {classify_expr('s.' + col)} AS Subgroup FROM {src} s "
            f"LEFT JOIN exact ex ON {norm_name('s.' + col)} = ex.name_norm")


def geno_expr(col: str, use: bool) -> str:
    if not use:
        return "'zzz'"
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in sorted(DEMO_GENOTYPES.items()))
    return f"CASE {col} {whens} ELSE 'zzz' END"


# ---------------------------------------------------------------------------
# Shared CTEs: adapter → sheets → prepare
# ---------------------------------------------------------------------------

def base_ctes() -> str:
    bm_rows = [(e, p, d, b) for e, p, d, b in demo_bucket_map()]
    ov_rows = list({(e, g, b): (e, g, b, lab) for e, g, b, lab in DEMO_OVERRIDES}.values())
    exact_rows = [(i, n, s) for i, (n, s) in enumerate(DEMO_EXACT)]
    drop_st = ", ".join(q(x) for x in RULES.drop_sample_types)
    drop_g = ", ".join(q(x) for x in RULES.drop_groups)
    keep_e = ", ".join(q(x) for x in RULES.keep_experiments)
    return f"""
li AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice,
         10.0 * pow(3.0, l_linenumber - 1) AS dose,
         round(100.0 - 2.2 * l_quantity, 1) AS neut,
         round(100.0 - 2.0 * l_quantity, 1) AS neut_raw
  FROM lineitem),
lines AS (
  SELECT l_orderkey, min(l_partkey) AS min_partkey,
         list(dose ORDER BY {ORD}, dose, neut, neut_raw) AS doses,
         list(neut ORDER BY {ORD}, dose, neut, neut_raw) AS neuts,
         list(neut_raw ORDER BY {ORD}, dose, neut, neut_raw) AS neuts_raw
  FROM li GROUP BY l_orderkey),
raw AS (
  SELECT o.o_orderkey AS row_id,
         coalesce(c.c_mktsegment, '') AS Sample_Type,
         o.o_orderstatus AS grp,
         'PSVX-' || CAST(100 + o.o_custkey % 30 AS VARCHAR) ||
           CASE WHEN o.o_orderstatus = 'F' THEN ' (R)' WHEN o.o_orderstatus = 'O' THEN '(c)' ELSE '' END AS PSVX_No,
         coalesce(n.n_name, '') AS PSV,
         CASE WHEN o.o_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(year(o.o_orderdate) AS VARCHAR) END AS Day,
         o.o_orderpriority AS Experiment,
         coalesce(p.p_name, '') AS Construct_Description,
         CASE WHEN ln.doses IS NULL THEN '' ELSE {arr_text('ln.doses', as_tuple='o.o_orderkey % 6 = 0')} END AS Dilution,
         CASE WHEN ln.doses IS NULL THEN '' ELSE {arr_text('ln.neuts', np_wrap='o.o_orderkey % 4 = 0')} END AS Neut_corr,
         CASE WHEN o.o_orderkey % 7 = 0 THEN 'NN' WHEN o.o_orderkey % 11 = 0 THEN ''
              WHEN o.o_orderkey % 13 = 0 THEN '>1000' ELSE format('{{:,.2f}}', o.o_totalprice) END AS IC50_corr,
         format('{{:,.2f}}', o.o_totalprice + 1000.0) AS IC50_raw,
         CASE WHEN ln.doses IS NULL THEN '' ELSE {arr_text('ln.neuts_raw')} END AS Neut_raw
  FROM orders o
  LEFT JOIN lines ln ON o.o_orderkey = ln.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN part p ON ln.min_partkey = p.p_partkey),
cs AS (
  SELECT s.s_suppkey AS row_id,
         CASE WHEN s.s_acctbal >= 0 THEN (CASE WHEN s.s_suppkey % 2 = 0 THEN 'ASSAY' ELSE ' assay ' END)
              ELSE 'OTHER' END AS Program,
         'PSVX-' || CAST(120 + s.s_nationkey AS VARCHAR) ||
           CASE WHEN s.s_suppkey % 5 = 0 THEN ' (C)' ELSE '' END AS PSVX_ID,
         CASE WHEN s.s_suppkey % 4 = 0 THEN 'F' WHEN s.s_suppkey % 4 = 1 THEN 'O'
              WHEN s.s_suppkey % 4 = 2 THEN 'P' ELSE '' END AS grp,
         CASE WHEN s.s_suppkey % 10 = 7 THEN ''
              ELSE (CASE WHEN s.s_suppkey % 3 = 0 THEN 'hot' WHEN s.s_suppkey % 3 = 1 THEN 'cold' ELSE 'new' END)
                   || ' ' || lower(n.n_name) END AS Construct_Description
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey),
filt AS (
  SELECT * FROM raw
  WHERE lower({strip('Sample_Type')}) NOT IN ({drop_st})
    AND {strip('grp')} NOT IN ({drop_g})
    AND {strip('Experiment')} IN ({keep_e})),
t0 AS (
  SELECT row_id, {strip('Experiment')} AS Experiment, {strip('grp')} AS grp, {strip('PSV')} AS PSV,
         {parse_number(txt('Day'))} AS Day, {cohort_id('PSVX_No')} AS PSVX_num,
         {strip('Construct_Description')} AS desc0,
         {parse_array('Dilution')} AS DilutionArray, {parse_array('Neut_corr')} AS NeutArray,
         {is_nn('IC50_corr')} AS Is_NN, {to_float('IC50_corr')} AS IC50
  FROM filt),
cs_rows AS (
  SELECT row_id AS rid, upper({cohort_id('PSVX_ID')}) AS lk_psvx, {strip('grp')} AS lk_grp,
         {strip('Construct_Description')} AS lk_desc
  FROM cs WHERE upper({strip('Program')}) = {q(RULES.program.upper())}),
cs_ok AS (SELECT * FROM cs_rows WHERE lk_psvx <> '' AND lk_desc <> '' AND lower(lk_desc) NOT IN ('nan', 'none', '')),
pair AS (SELECT lk_psvx, lk_grp, arg_max(lk_desc, rid) AS pair_desc FROM cs_ok WHERE lk_grp <> '' GROUP BY lk_psvx, lk_grp),
fb AS (SELECT lk_psvx AS fb_psvx, coalesce(arg_max(lk_desc, rid) FILTER (WHERE lk_grp = ''), arg_min(lk_desc, rid)) AS fb_desc
       FROM cs_ok GROUP BY lk_psvx),
t1 AS (
  SELECT t0.*, coalesce(pair.pair_desc, fb.fb_desc, t0.desc0) AS desc1
  FROM t0 LEFT JOIN pair ON upper(t0.PSVX_num) = pair.lk_psvx AND t0.grp = pair.lk_grp
          LEFT JOIN fb ON upper(t0.PSVX_num) = fb.fb_psvx),
bm AS (SELECT * FROM {values(bm_rows, ['bm_exp', 'bm_psvx', 'bm_day', 'bm_bucket'])}),
t2 AS (
  SELECT t1.*, coalesce(bm.bm_bucket, 'Unknown') AS Bucket_Type
  FROM t1 LEFT JOIN bm ON t1.Experiment = bm.bm_exp AND t1.PSVX_num = bm.bm_psvx
                       AND TRY_CAST(trunc(t1.Day) AS BIGINT) = bm.bm_day),
ov AS (SELECT * FROM {values(ov_rows, ['ov_exp', 'ov_grp', 'ov_bucket', 'ov_label'])}),
tidy AS (
  SELECT t2.row_id, t2.Experiment, t2.grp, t2.PSV, t2.Day, t2.PSVX_num,
         coalesce(ov.ov_label, t2.desc1) AS Construct_Description, t2.Bucket_Type,
         t2.IC50, t2.Is_NN, CASE WHEN t2.IC50 > 0 THEN log10(t2.IC50) END AS Log10_IC50,
         t2.DilutionArray, t2.NeutArray
  FROM t2 LEFT JOIN ov ON t2.Experiment = ov.ov_exp AND t2.grp = ov.ov_grp AND t2.Bucket_Type = ov.ov_bucket),
exact AS (
  SELECT {norm_name('name')} AS name_norm, arg_max(subgroup, ordinal) AS exact_subgroup
  FROM {values(exact_rows, ['ordinal', 'name', 'subgroup'])} GROUP BY 1),
constructs AS (
  {classify_join("(SELECT Construct_Description, count(*) AS n_rows FROM tidy GROUP BY 1)", "Construct_Description")}),
dd AS (
  SELECT CASE WHEN bool_or(d = 90.0) THEN 90.0 WHEN bool_or(d = 30.0) THEN 30.0
              ELSE coalesce(min(d), 30.0) END AS dose
  FROM (SELECT unnest(DilutionArray) AS d FROM tidy)),
anygrp AS (SELECT coalesce(bool_or(grp <> ''), false) AS has FROM tidy),
ftidy AS (SELECT tidy.* FROM tidy, anygrp WHERE tidy.grp <> '' OR NOT anygrp.has)"""


def bucket_list() -> str:
    return ", ".join(q(b) for b in BUCKETS)


def view_pct(src: str, dose: str, name: str) -> str:
    return f"""{name} AS (
  SELECT Bucket_Type, Construct_Description, PSV, {xavg('cv')} AS value, count(cv) AS n_tested, false AS all_nn
  FROM (SELECT s.*, {value_at('s.DilutionArray', 's.NeutArray', dose)} AS cv FROM {src} s
        WHERE s.Bucket_Type IN ({bucket_list()}))
  GROUP BY Bucket_Type, Construct_Description, PSV HAVING count(cv) > 0)"""


def view_all(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT Bucket_Type, Construct_Description, PSV, {xavg('pv[2]')} AS value, count(*) AS n_tested, false AS all_nn
  FROM (SELECT Bucket_Type, Construct_Description, PSV,
               unnest(list_slice(list_zip(DilutionArray, NeutArray), 1, least(len(DilutionArray), len(NeutArray)))) AS pv
        FROM {src} WHERE Bucket_Type IN ({bucket_list()}))
  GROUP BY 1, 2, 3)"""


def view_log(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT Bucket_Type, Construct_Description, PSV,
         CASE WHEN sum(CAST(Is_NN AS BIGINT)) = count(*) THEN NULL ELSE {xavg('Log10_IC50')} END AS value,
         count(*) AS n_tested, sum(CAST(Is_NN AS BIGINT)) = count(*) AS all_nn
  FROM {src} WHERE Bucket_Type IN ({bucket_list()}) GROUP BY 1, 2, 3)"""


def status_expr(metric: str, mode: str, thr: float, ge: bool) -> str:
    log = metric == "log10_ic50"
    parts = ["WHEN NOT (n_tested > 0) THEN 'not_tested'"]
    if log:
        parts.append("WHEN all_nn THEN 'nn'")
    parts.append(f"WHEN value IS NULL THEN {q('nn' if log else 'not_tested')}")
    if not log:
        parts.append("WHEN value <= 0 THEN 'nn'")
    if mode == "threshold":
        op = ">=" if ge else ">"
        last = f"CASE WHEN value {op} {float(thr)!r} THEN 'hit' ELSE 'miss' END"
    else:
        last = "'hit'"
    return "CASE " + " ".join(parts) + f" ELSE {last} END"


def grid_ctes(view: str, metric: str, mode: str, thr: float, ge: bool, bucket=None,
              sort_by="breadth", desc=True, geno=False, keys=(), prefix="g",
              target_order: str | None = None) -> str:
    """CTEs ending in ``{prefix}_grid`` (dense grid with ranks)."""
    K = ", ".join(keys)
    Kc = (K + ", ") if keys else ""
    pk = f"PARTITION BY {K}" if keys else ""
    bfilter = f"WHERE Bucket_Type = {q(bucket)}" if bucket and bucket != "All" else ""
    key = "row_breadth" if sort_by == "breadth" else "row_mean"
    direction = "ASC" if desc else "DESC"
    kj = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys) or "TRUE"
    if target_order is None:
        cols = f"""{prefix}_colstat AS (
  SELECT {Kc}PSV, CASE WHEN ct > 0 THEN cp::DOUBLE / ct ELSE 0.0 END AS col_breadth, {geno_expr('PSV', geno)} AS genotype
  FROM (SELECT {Kc}PSV, count_if(status IN ('hit', 'miss', 'nn')) AS ct, count_if(status IN ('hit', 'miss')) AS cp
        FROM {prefix}_cells GROUP BY {Kc}PSV)),
{prefix}_cols AS (
  SELECT *, row_number() OVER ({pk} ORDER BY genotype, 0.0 - col_breadth, PSV) AS col_rank FROM {prefix}_colstat),"""
        colj = kj("r", "c")
    else:
        cols = f"""{prefix}_cols AS (SELECT PSV, col_rank, CAST(NULL AS DOUBLE) AS col_breadth, 'zzz' AS genotype FROM {target_order}),"""
        colj = "TRUE"
    return f"""{prefix}_st AS (SELECT *, {status_expr(metric, mode, thr, ge)} AS status FROM {view} {bfilter}),
{prefix}_cells AS (
  SELECT {Kc}Construct_Description, PSV, {xavg('value')} AS value,
         CASE WHEN bool_or(status = 'hit') THEN 'hit' ELSE arg_min(status, Bucket_Type) END AS status,
         sum(n_tested) AS n_tested
  FROM {prefix}_st GROUP BY {Kc}Construct_Description, PSV),
{prefix}_rows AS (
  SELECT {Kc}Construct_Description,
         CASE WHEN nt > 0 THEN np::DOUBLE / nt ELSE 0.0 END AS row_breadth, coalesce(m, 0.0) AS row_mean, np, nt
  FROM (SELECT {Kc}Construct_Description, count_if(status IN ('hit', 'miss', 'nn')) AS nt,
               count_if(status IN ('hit', 'miss')) AS np, {xavg('value')} AS m
        FROM {prefix}_cells GROUP BY {Kc}Construct_Description)),
{prefix}_ranked AS (
  SELECT *, row_number() OVER ({pk} ORDER BY {key} {direction}, Construct_Description) AS export_rank,
         count(*) OVER ({pk}) AS n_rows FROM {prefix}_rows),
{cols}
{prefix}_grid AS (
  SELECT {', '.join('r.' + k for k in keys) + ', ' if keys else ''}r.Construct_Description, c.PSV, ce.value,
         coalesce(ce.status, 'not_tested') AS status, coalesce(ce.n_tested, 0) AS n_tested,
         r.row_breadth, r.row_mean, r.np, r.nt, r.export_rank, r.n_rows - r.export_rank + 1 AS row_rank,
         r.n_rows, c.col_rank, c.col_breadth, c.genotype
  FROM {prefix}_ranked r JOIN {prefix}_cols c ON {colj}
  LEFT JOIN {prefix}_cells ce ON {kj('ce', 'r')} AND ce.Construct_Description = r.Construct_Description AND ce.PSV = c.PSV)"""


def grid_select(src: str, keys=()) -> str:
    k = "".join(f"{x}, " for x in keys)
    return (f"SELECT {k}Construct_Description, PSV, round(value, 6) AS value, status, CAST(n_tested AS BIGINT) AS n_tested, "
            f"round(row_breadth, 6) AS row_breadth, round(row_mean, 6) AS row_mean, CAST(export_rank AS BIGINT) AS export_rank, "
            f"CAST(row_rank AS BIGINT) AS row_rank, CAST(col_rank AS BIGINT) AS col_rank, "
            f"round(col_breadth, 6) AS col_breadth, genotype FROM {src}")


def view_select(src: str) -> str:
    return (f"SELECT Bucket_Type, Construct_Description, PSV, round(value, 6) AS value, "
            f"CAST(n_tested AS BIGINT) AS n_tested, all_nn FROM {src}")


def arr_summary(a: str, name: str) -> str:
    return (f"CAST(len({a}) AS BIGINT) AS n_{name}, "
            f"round(coalesce(list_sum({a}), 0.0), 6) AS sum_{name}")


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join([base_ctes()] + [c for c in ctes if c])


def many_requests() -> str:
    """One view and grid for each request, side by side."""
    from .catalog import REQUESTS
    ctes, selects = [f"wtidy AS ({classify_join('tidy', 'Construct_Description')})"], []
    for k, (name, s) in enumerate(REQUESTS.items()):
        where = []
        for chosen, column in ((s.experiments, "Experiment"), (s.targets, "PSV")):
            if chosen or (s.empty_is_none and chosen is not None):
                where.append(f"{column} IN ({', '.join(map(q, chosen)) or 'NULL'})")
        if s.groups:
            where.append(f"grp IN ({', '.join(map(q, s.groups))})")
        elif s.default_group_filter and not (s.empty_is_none and s.groups is not None):
            where.append("(grp <> '' OR NOT (SELECT has FROM anygrp))")
        if s.subgroup != "All constructs":
            where.append(f"Subgroup = {q(s.subgroup)}")
        ctes.append(f"f{k} AS (SELECT wtidy.*, dd.dose FROM wtidy, dd WHERE {' AND '.join(where) or 'TRUE'})")
        if s.metric == "log10_ic50":
            ctes.append(view_log(f"f{k}", f"v{k}"))
        elif s.dilution == "all":
            ctes.append(view_all(f"f{k}", f"v{k}"))
        else:
            ctes.append(view_pct(f"f{k}", repr(s.dilution) if s.dilution is not None else "s.dose", f"v{k}"))
        ctes.append(grid_ctes(f"v{k}", s.metric, s.mode, s.threshold or 0.0, s.ge is not False, s.bucket, s.sort_by, s.sort_descending,
                              s.use_genotype, prefix=f"g{k}"))
        z = "CASE WHEN status = 'hit' THEN 1.0::DOUBLE END" if s.mode == "threshold" else "CASE WHEN status = 'hit' THEN value WHEN status = 'nn' THEN 0.0 END"
        shown = "" if s.mode == "threshold" else "WHEN status = 'hit' AND value IS NOT NULL THEN format('{:.1f}', value)"
        selects.append(grid_select(f"g{k}_grid").replace("SELECT ", f"SELECT {q(name)} AS spec_id, ", 1).replace(
            f" FROM g{k}_grid", f", round({z}, 6) AS z, CASE WHEN status = 'nn' THEN '0.00' {shown} END AS label, "
            f"CASE WHEN nt > 0 THEN np || '/' || nt END AS breadth_label FROM g{k}_grid"))
    return W(*ctes) + "\n" + "\nUNION ALL ".join(selects)


def panel_ctes() -> str:
    pn = values(list(enumerate(DEMO_PANEL)), ["ord", "name"])
    return f"""pn AS (SELECT * FROM {pn}),
tg AS (SELECT DISTINCT PSV FROM tidy),
hx AS (SELECT pn.ord, pn.name, coalesce(bool_or(tg.PSV = pn.name), false) AS has FROM pn LEFT JOIN tg ON TRUE GROUP BY pn.ord, pn.name),
pm AS (SELECT tg.PSV, min(hx.ord) AS ord FROM tg JOIN hx ON (CASE WHEN hx.has THEN tg.PSV = hx.name
        ELSE contains(lower(tg.PSV), lower(hx.name)) END) GROUP BY tg.PSV),
matched AS (SELECT PSV, row_number() OVER (ORDER BY ord, PSV) AS col_rank FROM pm)"""


def top_ctes() -> str:
    return f"""{panel_ctes()},
fpanel AS (SELECT * FROM ftidy WHERE PSV IN (SELECT PSV FROM matched)),
{view_pct('fpanel', '90.0', 'vpanel')},
scores AS (SELECT Construct_Description, count_if(value > 0) AS n_positive,
                  coalesce({xsum('CASE WHEN value > 0 THEN value END')}, 0.0) AS total FROM vpanel GROUP BY 1),
cands AS ({classify_join("(SELECT DISTINCT Construct_Description FROM fpanel)", "Construct_Description")}),
scored AS (SELECT c.Subgroup, c.Construct_Description, coalesce(s.n_positive, 0) AS n_positive,
                  coalesce(s.total, 0.0) AS total
           FROM cands c LEFT JOIN scores s ON c.Construct_Description = s.Construct_Description),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Subgroup ORDER BY n_positive DESC, total DESC,
                 Construct_Description) AS top_rank FROM scored) WHERE top_rank <= 4
        AND Subgroup IN ({', '.join(q(s) for s in RULES.subgroup_order)}))"""


def oracle_sql() -> dict[str, str]:
    sg_list = ", ".join(q(s) for s in RULES.subgroup_order)
    out: dict[str, str] = {}
    out["q01_scan_resolve"] = W() + """
SELECT row_id, Sample_Type AS sample, grp AS "group", PSVX_No AS psvx, PSV AS psv, Day AS day,
       Experiment AS experiment, Construct_Description AS "desc", Dilution AS dilution, Neut_corr AS neut,
       IC50_corr AS ic50 FROM raw"""
    out["q01b_ragged_sheets"] = W() + """
SELECT CASE WHEN long THEN 'reject' ELSE 'row' END AS kind, row_id AS id, grp, CASE WHEN short THEN '' ELSE 'first' END AS "first",
       CASE WHEN long THEN 'beyond' WHEN short THEN '' WHEN row_id % 2 = 0 THEN 'second' ELSE 'first' END AS "last",
       CASE WHEN row_id % 2 = 0 THEN 2 ELSE 1 END AS n
FROM (SELECT row_id, coalesce(grp, '') AS grp, row_id % 7 = 3 AS short, row_id % 11 = 5 AND row_id % 7 <> 3 AS long FROM raw)"""
    out["q02_base_filters"] = W() + """
SELECT row_id, Sample_Type AS sample, grp AS "group", PSVX_No AS psvx, PSV AS psv, Day AS day,
       Experiment AS experiment, Construct_Description AS "desc", Dilution AS dilution, Neut_raw AS neut,
       IC50_raw AS ic50 FROM filt"""
    out["q03_tidy"] = W() + f"""
SELECT t.row_id, t.Experiment, t.grp AS "Group", t.PSV, round(t.Day, 6) AS Day, t.PSVX_num,
       t.Construct_Description, t.Bucket_Type, c.Subgroup, round(t.IC50, 6) AS IC50, t.Is_NN,
       round(t.Log10_IC50, 6) AS Log10_IC50, {arr_summary('t.DilutionArray', 'dil')}, {arr_summary('t.NeutArray', 'neut')}
FROM tidy t LEFT JOIN constructs c ON t.Construct_Description = c.Construct_Description"""
    out["q04_parse_arrays"] = W() + f"""
SELECT row_id, {arr_summary(parse_array('Dilution'), 'dil')}, {arr_summary(parse_array('Neut_corr'), 'neut')},
       {arr_summary(parse_array('Neut_raw'), 'neut_raw')} FROM raw"""
    potency, number = f"upper({strip(txt('IC50_raw'))})", to_float("IC50_raw")
    variant_nn = f"({potency} IN ({', '.join(q(t) for t in NN_TOKENS_VARIANT)}) OR {number} IS NULL OR {number} <= 0)"
    out["q04b_potency_variant"] = W() + f"""
SELECT row_id, round(CASE WHEN {variant_nn} THEN 0.0 ELSE log10({number}) END, 6) AS log10, {variant_nn} AS is_nn FROM raw"""
    vals = ", ".join(f"round({value_at('DilutionArray', 'NeutArray', d)}, 6) AS {nm}" for nm, d in
                     (("v30", "30.0"), ("v30_009", "30.009"), ("v30_02", "30.02"), ("v90", "90.0"),
                      ("v7290", "7290.0")))
    out["q05_value_at_dose"] = W() + f"\nSELECT row_id, {vals} FROM tidy"
    out["q06_build_lookup"] = W() + """
SELECT 'pair' AS kind, lk_psvx AS psvx, lk_grp AS grp, pair_desc AS description FROM pair
UNION ALL SELECT 'fallback', fb_psvx, '', fb_desc FROM fb"""
    out["q07_resolve_description"] = W() + """
SELECT row_id, PSVX_num, grp AS "Group", desc1 AS Construct_Description FROM t1"""
    out["q08_bucket_override"] = W() + """
SELECT row_id, Experiment, round(Day, 6) AS Day, TRY_CAST(trunc(Day) AS BIGINT) AS day_int, Bucket_Type,
       Construct_Description FROM tidy"""
    out["q09_classify"] = W() + """
SELECT Construct_Description, Subgroup, CAST(n_rows AS BIGINT) AS n_rows FROM constructs"""
    part_pattern = PART_PATTERN.replace("STRING", "VARCHAR")
    out["q09b_classify_rule_table"] = W() + f"""
SELECT c.Construct_Description, coalesce(nullif(any_value(ex.exact_subgroup), ''), arg_min(r.subgroup, r.ordinal), {q(RULES.uncategorized)}) AS Subgroup,
       CAST(any_value(c.n_rows) AS BIGINT) AS n_rows
FROM constructs c LEFT JOIN exact ex ON {norm_name('c.Construct_Description')} = ex.name_norm
LEFT JOIN (SELECT p_partkey AS ordinal, {part_pattern} AS pattern, p_brand AS subgroup FROM part) r
  ON regexp_matches({strip('c.Construct_Description')}, '(?i)' || r.pattern)
GROUP BY c.Construct_Description"""
    out["q10_view_single_dose"] = W(view_pct("(SELECT tidy.*, dd.dose FROM tidy, dd)", "s.dose", "v")) + \
        "\n" + view_select("v")
    out["q11_view_all_doses"] = W(view_all("tidy", "v")) + "\n" + view_select("v")
    out["q12_view_log10"] = W(view_log("tidy", "v")) + "\n" + view_select("v")
    out["q13_cell_status"] = W(view_pct("tidy", "30.0", "v")) + f"""
SELECT Bucket_Type, Construct_Description, PSV, round(value, 6) AS value,
       {status_expr('pct_neut', 'threshold', 75.0, False)} AS status FROM v"""
    targets = ", ".join(q(f"NATION_{i}") for i in range(0, 25, 2))
    out["q14_view_filters"] = W(
        f"fsel AS (SELECT * FROM tidy WHERE Experiment IN ('1-URGENT', '2-HIGH') AND PSV IN ({targets}) AND grp IN ('F'))",
        view_pct("fsel", "30.0", "v0"),
        f"v AS ({classify_join('v0', 'Construct_Description')})") + \
        "\nSELECT Bucket_Type, Construct_Description, PSV, round(value, 6) AS value, CAST(n_tested AS BIGINT) AS n_tested, " \
        "all_nn, Subgroup FROM v WHERE Subgroup = '2. Widgets'"
    out["q14b_many_requests"] = many_requests()
    g15 = [view_pct("tidy", "90.0", "v15"), grid_ctes("v15", "pct_neut", "threshold", 50.0, True, prefix="g")]
    out["q15_grid"] = W(*g15) + "\n" + grid_select("g_grid")
    out["q16_grid_rows_ranked"] = W(
        view_log("ftidy", "v"),
        grid_ctes("v", "log10_ic50", "gradient", 3.0, True, bucket="Boost1", sort_by="mean_value", desc=False),
        """g16 AS (SELECT *, round(CASE WHEN status = 'hit' THEN value WHEN status = 'nn' THEN 0.0 END, 6) AS z,
             CASE WHEN status = 'nn' THEN '0.00' WHEN status = 'hit' AND value IS NOT NULL
                  THEN format('{:.1f}', value) END AS label FROM g_grid)""") + \
        "\n" + grid_select("g16").replace(" FROM g16", ", z, label FROM g16")
    out["q17_small_multiples"] = W(
        view_pct("ftidy", "30.0", "v0"),
        f"v AS (SELECT * FROM ({classify_join('v0', 'Construct_Description')}) WHERE Subgroup IN ({sg_list}))",
        grid_ctes("v", "pct_neut", "threshold", 50.0, True, geno=True, keys=("Subgroup",))) + \
        "\n" + grid_select("g_grid", ("Subgroup",))
    out["q18_panel_match"] = W(panel_ctes()) + "\nSELECT PSV, CAST(col_rank AS BIGINT) AS col_rank FROM matched"
    out["q19_top_n"] = W(top_ctes()) + """
SELECT Subgroup, Construct_Description, CAST(n_positive AS BIGINT) AS n_positive, round(total, 6) AS total,
       CAST(top_rank AS BIGINT) AS top_rank FROM top"""
    out["q20_top_summary"] = W(
        top_ctes(),
        "vtop AS (SELECT v.*, top.Subgroup FROM vpanel v JOIN top ON v.Construct_Description = top.Construct_Description)",
        grid_ctes("vtop", "pct_neut", "threshold", 50.0, True, keys=("Subgroup",), target_order="matched")) + """
SELECT Subgroup, Construct_Description, PSV, round(value, 6) AS value, status, CAST(export_rank AS BIGINT) AS export_rank,
       CAST(row_rank AS BIGINT) AS row_rank, CAST(col_rank AS BIGINT) AS col_rank FROM g_grid"""
    out["q21_curve"] = W() + f"""
SELECT Construct_Description, PSV, round(pv[1], 6) AS dilution, round({xavg('pv[2]')}, 6) AS pct_neut, count(*) AS n_obs
FROM (SELECT Construct_Description, PSV, unnest(list_zip(DilutionArray, NeutArray)) AS pv FROM tidy
      WHERE len(DilutionArray) > 0 AND len(DilutionArray) = len(NeutArray))
GROUP BY Construct_Description, PSV, pv[1]"""
    out["q21b_curve_request"] = W() + f"""
SELECT Construct_Description, PSV, round(d, 6) AS dilution, round(m, 6) AS pct_neut,
       row_number() OVER (PARTITION BY Construct_Description, PSV ORDER BY d) AS dose_rank, 75.0::DOUBLE AS threshold
FROM (SELECT Construct_Description, PSV, pv[1] AS d, {xavg('pv[2]')} AS m
      FROM (SELECT Construct_Description, PSV, unnest(list_zip(DilutionArray, NeutArray)) AS pv FROM tidy
            WHERE len(DilutionArray) > 0 AND len(DilutionArray) = len(NeutArray) AND PSV = 'NATION_3' AND Bucket_Type = 'Boost1')
      GROUP BY Construct_Description, PSV, pv[1])"""
    out["q22_diagnostics"] = W() + f"""
SELECT (SELECT count(*) FROM raw) AS n_raw, (SELECT count(*) FROM filt) AS n_after_filter,
       (SELECT count_if(Bucket_Type = 'Unknown') FROM tidy) AS n_unknown_bucket,
       (SELECT coalesce(sum(CASE WHEN Subgroup = {q(RULES.uncategorized)} THEN n_rows END), 0) FROM constructs) AS n_uncategorized,
       'All constructs  ·  All (pooled)  ·  % neut @ 1:' || CAST(CAST((SELECT dose FROM dd) AS BIGINT) AS VARCHAR) || '  ·  ≥50.0' AS title"""
    out["q22b_grid_sizes"] = W(
        view_pct("ftidy", "30.0", "v0"),
        f"v AS (SELECT * FROM ({classify_join('v0', 'Construct_Description')}) WHERE Subgroup IN ({sg_list}))",
        grid_ctes("v", "pct_neut", "threshold", 50.0, True, geno=True, keys=("Subgroup",))) + """
SELECT Subgroup, CAST(count(DISTINCT Construct_Description) AS BIGINT) AS n_constructs,
       CAST(count(DISTINCT PSV) AS BIGINT) AS n_targets,
       Subgroup || '  ·  ' || CAST(count(DISTINCT Construct_Description) AS VARCHAR) || ' constructs × ' ||
       CAST(count(DISTINCT PSV) AS VARCHAR) || ' PSVs' AS title
FROM g_grid GROUP BY Subgroup"""
    bk_vals = values(list(enumerate(BUCKETS)), ["ordinal", "value"])
    sg_vals = values(list(enumerate(RULES.subgroup_order)), ["ordinal", "value"])
    out["q23_domains"] = W(f"""dom AS (
  SELECT 'dilutions' AS domain, d AS k, CAST(d AS VARCHAR) AS value FROM (SELECT DISTINCT unnest(DilutionArray) AS d FROM tidy)
  UNION ALL SELECT DISTINCT 'experiments', 0.0, Experiment FROM tidy
  UNION ALL SELECT DISTINCT 'groups', 0.0, grp FROM tidy WHERE grp <> ''
  UNION ALL SELECT DISTINCT 'psvs', 0.0, PSV FROM tidy
  UNION ALL SELECT 'subgroups_present', CAST(o.ordinal AS DOUBLE), o.value FROM {sg_vals.replace('AS t(', 'AS o(')}
            WHERE o.value IN (SELECT Subgroup FROM constructs)
  UNION ALL SELECT 'buckets_present', CAST(b.ordinal AS DOUBLE), b.value FROM {bk_vals.replace('AS t(', 'AS b(')}
            WHERE b.value IN (SELECT Bucket_Type FROM tidy))""") + """
SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY k, value) AS BIGINT) AS ordinal, value FROM dom"""
    out["q24_export_long"] = W(*g15) + """
SELECT Construct_Description, PSV, round(value, 6) AS value, status,
       CAST((col_rank - 1) * n_rows + export_rank AS BIGINT) AS export_seq FROM g_grid"""
    out["q24b_export_file"] = W(*g15) + """
SELECT Construct_Description, PSV, round(value, 6) AS value, status,
       CAST((col_rank - 1) * n_rows + export_rank AS BIGINT) AS export_seq,
       row_number() OVER (ORDER BY (col_rank - 1) * n_rows + export_rank) AS file_place FROM g_grid"""
    out["q25_pivot_wide"] = W(*g15, "gw AS (SELECT Construct_Description, CAST(export_rank AS BIGINT) AS export_rank, PSV, "
                              "round(value, 6) AS value FROM g_grid)") + """
SELECT Construct_Description, export_rank, """ + ", ".join(
        f"max(value) FILTER (WHERE PSV = 'NATION_{k}') AS \"NATION_{k}\"" for k in range(25)) + """
FROM gw GROUP BY Construct_Description, export_rank"""
    out["q26_unpivot"] = W(*g15) + """
SELECT Construct_Description, CAST(export_rank AS BIGINT) AS export_rank, PSV, round(value, 6) AS value FROM g_grid"""
    (t0, t1), (b0, b1) = FIT_TOP_BOUNDS, FIT_BOTTOM_BOUNDS
    slopes = ", ".join(f"{float(v)!r}::DOUBLE" for v in GRID_SLOPES)
    in_b, in_t = (lambda v: f"least(greatest({v}, {b0}), {b1})"), (lambda v: f"least(greatest({v}, {t0}), {t1})")
    out["q27b_fit_bounded"] = W(f"""pt AS (
  SELECT Construct_Description AS c, PSV AS t, pv[1] AS x, {xavg('pv[2]')} AS y
  FROM (SELECT Construct_Description, PSV, unnest(list_zip(DilutionArray, NeutArray)) AS pv FROM tidy
        WHERE len(DilutionArray) > 0 AND len(DilutionArray) = len(NeutArray)) GROUP BY ALL),
pr AS (SELECT c, t, count(*) AS n, min(x) AS lo, max(x) AS hi, min(y) AS y0, max(y) AS y1 FROM pt GROUP BY c, t),
nd AS (SELECT c, t, s, k, pow(10.0, log10(lo) + k * ((log10(hi) - log10(lo)) / {GRID_IC50 - 1}.0)) AS ic
       FROM pr, range({GRID_IC50}) r(k), unnest([{slopes}]) q(s) WHERE n >= {FIT_MIN_POINTS} AND lo > 0),
us AS (SELECT c, t, s, k, 1.0 / (1.0 + pow(x / ic, s)) AS u, y FROM nd JOIN pt USING (c, t)),
sm AS (SELECT c, t, s, k, sum((1 - u) * (1 - u)) AS bb, sum(u * (1 - u)) AS bt, sum(u * u) AS tt, sum((1 - u) * y) AS gy, sum(u * y) AS ty
       FROM us GROUP BY c, t, s, k),
sol AS (SELECT *, (gy * tt - ty * bt) / nullif(bb * tt - bt * bt, 0) AS b, (bb * ty - bt * gy) / nullif(bb * tt - bt * bt, 0) AS tp FROM sm),
cand AS (SELECT c, t, s, k, b, tp FROM sol WHERE b BETWEEN {b0} AND {b1} AND tp BETWEEN {t0} AND {t1}
  UNION SELECT c, t, s, k, {in_b(f'(gy - v * bt) / bb')}, v FROM sol, (VALUES ({t0}::DOUBLE), ({t1}::DOUBLE)) z(v)
  UNION SELECT c, t, s, k, v, {in_t(f'(ty - v * bt) / tt')} FROM sol, (VALUES ({b0}::DOUBLE), ({b1}::DOUBLE)) z(v)),
er AS (SELECT c, t, min(sse) AS grid_sse FROM (
  SELECT c, t, s, k, b, tp, sum(pow(b + (tp - b) * u - y, 2)) AS sse FROM cand JOIN us USING (c, t, s, k) GROUP BY ALL) GROUP BY c, t),
st AS (SELECT *, CASE WHEN n < {FIT_MIN_POINTS} THEN 'too_few_points' WHEN lo <= 0 OR y1 NOT BETWEEN {t0} AND {t1}
         OR y0 NOT BETWEEN {b0} AND {b1} THEN 'failed' ELSE 'ok' END AS fit_status FROM pr)""") + """
SELECT c AS Construct_Description, t AS PSV, n AS n_points, round(lo, 6) AS x_min, round(hi, 6) AS x_max, fit_status, round(grid_sse, 2) AS grid_sse,
       CASE WHEN fit_status = 'ok' THEN true END AS in_bounds, CASE WHEN fit_status = 'ok' THEN true END AS not_above_grid
FROM st LEFT JOIN er USING (c, t)"""
    out["q29_hill_fixed"] = W("""cv AS (
  SELECT Construct_Description, PSV, min(pv[1]) AS lo, max(pv[1]) AS hi
  FROM (SELECT Construct_Description, PSV, unnest(list_zip(DilutionArray, NeutArray)) AS pv FROM tidy
        WHERE len(DilutionArray) > 0 AND len(DilutionArray) = len(NeutArray))
  GROUP BY 1, 2)""") + """
SELECT Construct_Description, PSV, CAST(i AS BIGINT) AS point, round(x, 4) AS x,
       round(0.0 + (100.0 - 0.0) / (1.0 + pow(x / 300.0, 1.0)), 4) AS y
FROM (SELECT Construct_Description, PSV, i,
             pow(10.0, log10(lo * 0.5) + CAST(i AS DOUBLE) * ((log10(hi * 2.0) - log10(lo * 0.5)) / 299.0)) AS x
      FROM cv, range(300) r(i))"""
    return out
