"""Four-parameter logistic fit per (construct, target) (C3) and the fitted
line / IC50 marker (C4, X12, X13).

The fit is the one place where Python runs in the executors: each pair of the
curve table (already aggregated to one row per dose) becomes two arrays, and the
pairs of an Arrow batch are fitted together by a bounded Levenberg-Marquardt in
numpy.  The line is then generated JVM-side.  ``grid_errors`` bounds the error of
a fit by plain expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (FIT_BOTTOM_BOUNDS, FIT_IC50_FACTORS, FIT_LINE_POINTS, FIT_LINE_SPAN,
                      FIT_MAX_EVALS, FIT_MIN_POINTS, FIT_SLOPE_BOUNDS, FIT_TOP_BOUNDS)
from ..functions.hill import hill4pl, logspace_points

C, T = "Construct_Description", "PSV"

# The grouped-map function travels by value, so executors need numpy and
# pandas but not this package on their path.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

#: Nodes of :func:`grid_errors`: ic50 values over a pair's doses, slopes.
GRID_IC50 = 16
GRID_SLOPES = (0.1, 0.5, 1.0, 2.0, 4.0, 10.0)

#: Pairs fitted together.
FIT_BATCH = 512
FTOL = 1e-8
XTOL = 1e-8

FIT_SCHEMA = (f"{C} string, {T} string, n_points bigint, x_min double, x_max double, "
              "top double, bottom double, ic50 double, slope double, sse double, fit_status string")


def fit_hill(x, y, max_evals: int = FIT_MAX_EVALS):
    """One pair; see :func:`fit_hill_many`."""
    return fit_hill_many([x], [y], max_evals)[0]


def fit_hill_many(xs: list, ys: list, max_evals: int = FIT_MAX_EVALS, starts: list | None = None):
    """Bounded least squares for the 4PL model, many pairs at once.

    Start (max y, min y, median x, 1) or that of ``starts`` (top, bottom, ic50,
    slope); bounds top / bottom / ic50 (multiples of
    min and max dose) / slope.  A start value outside the bounds is a failed
    fit (as a bounded solver refuses it), and so is one that needs more than
    ``max_evals`` model values (the Jacobian is analytic and not counted).
    Parameters are (top, bottom, ln ic50, slope); damped normal equations, steps
    clipped to the bounds, accepted only when the squared error falls.

    Points are padded to a common length with zero weight; every pair keeps
    its own damping, evaluation count and stopping state.  Returns a list of
    (top, bottom, ic50, slope, sse, status)."""
    k = len(xs)
    out = [None] * k
    idx = []
    for i, (x, y) in enumerate(zip(xs, ys)):
        x = np.asarray(x, float)
        y = np.asarray(y, float)
        lo = np.array([FIT_TOP_BOUNDS[0], FIT_BOTTOM_BOUNDS[0], np.log(x.min() * FIT_IC50_FACTORS[0]),
                       FIT_SLOPE_BOUNDS[0]])
        hi = np.array([FIT_TOP_BOUNDS[1], FIT_BOTTOM_BOUNDS[1], np.log(x.max() * FIT_IC50_FACTORS[1]),
                       FIT_SLOPE_BOUNDS[1]])
        top, bottom, ic50, slope = starts[i] if starts else (y.max(), y.min(), np.median(x), 1.0)
        p0 = np.array([top, bottom, np.log(ic50), slope])
        if np.any(p0 < lo) or np.any(p0 > hi) or not np.all(np.isfinite(p0)):
            out[i] = (None, None, None, None, None, "failed")
        else:
            idx.append((i, x, y, lo, hi, p0))
    if not idx:
        return out
    n = len(idx)
    m = max(len(t[1]) for t in idx)
    lx = np.zeros((n, m))
    yy = np.zeros((n, m))
    w = np.zeros((n, m))
    lo = np.stack([t[3] for t in idx])
    hi = np.stack([t[4] for t in idx])
    p = np.stack([t[5] for t in idx])
    for j, t in enumerate(idx):
        c = len(t[1])
        lx[j, :c] = np.log(t[1])
        yy[j, :c] = t[2]
        w[j, :c] = 1.0

    def model(pp, rows):
        top, bottom, lic, sl = (pp[:, q][:, None] for q in range(4))
        z = np.clip(sl * (lx[rows] - lic), -700.0, 700.0)
        u = np.exp(z)
        den = 1.0 + u
        f = bottom + (top - bottom) / den
        jac = np.empty((len(rows), m, 4))
        jac[:, :, 0] = 1.0 / den
        jac[:, :, 1] = u / den
        jac[:, :, 2] = (top - bottom) * sl * u / den ** 2
        jac[:, :, 3] = -(top - bottom) * u * (lx[rows] - lic) / den ** 2
        r = (f - yy[rows]) * w[rows]
        return r, jac * w[rows][:, :, None]

    allr = np.arange(n)
    r, jac = model(p, allr)
    sse = np.einsum("ij,ij->i", r, r)
    lam = np.full(n, 1e-3)
    evals = np.ones(n, dtype=int)
    active = np.ones(n, dtype=bool)
    while active.any():
        at = np.nonzero(active)[0]
        ja, ra = jac[at], r[at]
        a = np.einsum("kmi,kmj->kij", ja, ja)
        g = np.einsum("kmi,km->ki", ja, ra)
        diag = np.einsum("kii->ki", a)
        damp = a + (lam[at][:, None] * (diag + 1e-12))[:, :, None] * np.eye(4)[None]
        try:
            delta = -np.linalg.solve(damp, g[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            delta = -(np.linalg.pinv(damp) @ g[:, :, None])[:, :, 0]
        solved = np.isfinite(delta).all(axis=1)
        cand = np.clip(p[at] + np.where(solved[:, None], delta, 0.0), lo[at], hi[at])
        rc, jc = model(cand, at)
        sc = np.einsum("ij,ij->i", rc, rc)
        evals[at] += 1
        better = solved & (sc < sse[at])
        gain = (sse[at] - sc) / np.maximum(sse[at], 1e-300)
        small = np.max(np.abs(delta) / (np.abs(cand) + 1e-8), axis=1) < XTOL
        take = at[better]
        p[take], r[take], jac[take], sse[take] = cand[better], rc[better], jc[better], sc[better]
        lam[at] = np.where(better, np.maximum(lam[at] / 3.0, 1e-12), lam[at] * np.where(solved, 4.0, 10.0))
        done = np.where(better, (gain < FTOL) | small, lam[at] > 1e12)
        active[at[done | (evals[at] >= max_evals)]] = False
    for j, t in enumerate(idx):
        if evals[j] >= max_evals:
            out[t[0]] = (None, None, None, None, None, "failed")
        else:
            top, bottom, lic, sl = p[j]
            out[t[0]] = (float(top), float(bottom), float(np.exp(lic)), float(sl), float(sse[j]), "ok")
    return out


def _fit_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fits for rows of one pair each: its doses ``xs`` and responses ``ys`` by dose."""
    xs, ys = (([np.asarray(v, float) for v in pdf[c]]) for c in ("xs", "ys"))
    todo = [i for i, x in enumerate(xs) if len(x) >= FIT_MIN_POINTS and np.all(x > 0)]
    res = dict(zip(todo, fit_hill_many([xs[i] for i in todo], [ys[i] for i in todo])))
    if "_start" in pdf:
        inside = lambda v, bounds: bounds[0] <= v <= bounds[1]
        again = [i for i in todo if inside(ys[i].max(), FIT_TOP_BOUNDS) and inside(ys[i].min(), FIT_BOTTOM_BOUNDS)]
        more = fit_hill_many([xs[i] for i in again], [ys[i] for i in again], starts=[tuple(pdf["_start"].iloc[i]) for i in again])
        res.update({i: fit for i, fit in zip(again, more) if fit[-1] == "ok" and (res[i][-1] != "ok" or fit[4] < res[i][4])})
    none = (None,) * 5
    fits = [res.get(i) or (*none, "too_few_points" if len(x) < FIT_MIN_POINTS else "failed") for i, x in enumerate(xs)]
    out = pdf[[C, T]].assign(n_points=[len(x) for x in xs], x_min=[x.min() for x in xs], x_max=[x.max() for x in xs])
    for k, name in enumerate(("top", "bottom", "ic50", "slope", "sse", "fit_status")):
        out[name] = [f[k] for f in fits]
    return out


def _fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair's curve rows (used by tests)."""
    pdf = pdf.sort_values("dilution")
    return _fit_rows(pd.DataFrame({C: pdf[C].iloc[:1], T: pdf[T].iloc[:1], "xs": [pdf["dilution"].to_numpy()],
                                   "ys": [pdf["pct_neut"].to_numpy()]}))


def _pairs(curve: DataFrame) -> DataFrame:
    """The curve of a pair as two arrays by dose (one element a dose)."""
    point = F.struct("dilution", "pct_neut")
    return curve.groupBy(C, T).agg(F.sort_array(F.collect_list(point)).alias("_points")).select(
        C, T, F.col("_points.dilution").alias("xs"), F.col("_points.pct_neut").alias("ys"))


def fit_curves(curve: DataFrame, buckets: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """One fit row per (construct, target) of a curve table.

    With ``nodes`` (:func:`grid_errors`) a pair whose usual start lies in the bounds is
    fitted from its best node too, and the lower error wins: on shapeless points the
    usual start often ends in a worse optimum than the grid's, or in none.

    A pair's points (one per dose) become two arrays; the pairs of an Arrow
    batch are fitted together, so what a worker holds is bounded by the batch."""
    pairs = _pairs(curve)
    if nodes is not None:
        start = F.array("grid_top", "grid_bottom", "grid_ic50", "grid_slope").alias("_start")
        pairs = pairs.join(nodes.select(C, T, start), [C, T], "left")
    if buckets:
        pairs = pairs.repartition(buckets, C, T)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), FIT_BATCH):
                yield _fit_rows(pdf.iloc[at:at + FIT_BATCH].reset_index(drop=True))

    return pairs.mapInPandas(run, FIT_SCHEMA)


def grid_errors(curve: DataFrame, n_ic50: int = GRID_IC50, slopes: tuple = GRID_SLOPES) -> DataFrame:
    """The least squared error of each fittable pair over a fixed grid of (ic50,
    slope), and where it lies: (construct, target, grid_sse, grid_top, grid_bottom,
    grid_ic50, grid_slope).

    With these two fixed the model is linear in top and bottom, so their best
    values follow from sums over the points; where they leave their bounds the
    best point of the four edges is taken.  ic50 runs over ``n_ic50`` log-spaced
    doses of the pair's own span.  Plain expressions: nodes are exploded and
    reduced to their minimum before anything is shuffled."""
    pairs = _pairs(curve).where((F.size("xs") >= FIT_MIN_POINTS) & (F.array_min("xs") > 0))
    ic50s = logspace_points(F.array_min("xs"), F.array_max("xs"), n_ic50)
    nodes = pairs.withColumn("_ic50", F.explode(ic50s)).withColumn("_slope", F.explode(F.array(*[F.lit(float(v)) for v in slopes])))
    share = F.transform("xs", lambda x: 1.0 / (1.0 + F.pow(x / F.col("_ic50"), F.col("_slope"))))
    points = nodes.select(C, T, "_ic50", "_slope", F.arrays_zip(share.alias("u"), F.col("ys").alias("y")).alias("_p"))

    def total(of) -> Column:
        return F.aggregate("_p", F.lit(0.0), lambda acc, p: acc + of(p["u"], p["y"]))

    sums = points.select(C, T, "_ic50", "_slope", "_p", total(lambda u, y: (1.0 - u) * (1.0 - u)).alias("bb"), total(lambda u, y: u * (1.0 - u)).alias("bt"),
                         total(lambda u, y: u * u).alias("tt"), total(lambda u, y: (1.0 - u) * y).alias("by"), total(lambda u, y: u * y).alias("ty"))
    bb, bt, tt, by, ty = (F.col(k) for k in ("bb", "bt", "tt", "by", "ty"))
    det = F.nullif(bb * tt - bt * bt, F.lit(0.0))
    low, high = FIT_BOTTOM_BOUNDS, FIT_TOP_BOUNDS
    within = lambda v, bounds: F.least(F.greatest(v, F.lit(bounds[0])), F.lit(bounds[1]))
    bottom, top = (by * tt - ty * bt) / det, (bb * ty - bt * by) / det
    both = F.when(bottom.between(*low) & top.between(*high), F.struct(bottom.alias("b"), top.alias("t")))
    # ic50 lies among the doses, so bb and tt are at least a quarter
    edges = [F.struct(within((by - t * bt) / bb, low).alias("b"), F.lit(t).alias("t")) for t in high]
    edges += [F.struct(F.lit(b).alias("b"), within((ty - b * bt) / tt, high).alias("t")) for b in low]
    tried = sums.select(C, T, "_ic50", "_slope", "_p", F.explode(F.array_compact(F.array(both, *edges))).alias("_at"))
    miss = lambda p: F.col("_at.b") + (F.col("_at.t") - F.col("_at.b")) * p["u"] - p["y"]
    error = F.aggregate("_p", F.lit(0.0), lambda acc, p: acc + miss(p) * miss(p))
    node = F.struct(error.alias("grid_sse"), F.col("_at.t").alias("grid_top"), F.col("_at.b").alias("grid_bottom"),
                    F.col("_ic50").alias("grid_ic50"), F.col("_slope").alias("grid_slope"))
    return tried.select(C, T, node.alias("_node")).groupBy(C, T).agg(F.min("_node").alias("_node")).select(C, T, "_node.*")


def fit_lines(fits: DataFrame, n: int = FIT_LINE_POINTS) -> DataFrame:
    """C4: ``n`` log-spaced points from 0.5·min to 2·max dose on each fitted
    curve, plus the IC50 marker point (kind = 'line' / 'ic50')."""
    ok = fits.filter(F.col("fit_status") == "ok")
    lo = F.col("x_min") * F.lit(FIT_LINE_SPAN[0])
    hi = F.col("x_max") * F.lit(FIT_LINE_SPAN[1])
    pts = ok.select(C, T, "top", "bottom", "ic50", "slope",
                    F.posexplode(logspace_points(lo, hi, n)).alias("point", "x"))
    line = pts.select(C, T, F.lit("line").alias("kind"), F.col("point").cast("bigint"), "x",
                      hill4pl("x", "top", "bottom", "ic50", "slope").alias("y"))
    marker = ok.select(C, T, F.lit("ic50").alias("kind"), F.lit(-1).cast("bigint").alias("point"),
                       F.col("ic50").alias("x"),
                       hill4pl("ic50", "top", "bottom", "ic50", "slope").alias("y"))
    return line.unionByName(marker)
