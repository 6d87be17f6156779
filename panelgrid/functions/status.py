"""Cell status, cell encoding and title expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    HIT, MISS, NN, NOT_TESTED, TITLE_DOSE_LOG, TITLE_DOSE_PCT, TITLE_MULTIPLE,
    TITLE_POOLED, TITLE_SEP, TITLE_THRESHOLD,
)
from .text import _c


def _is(x, name: str) -> Column:
    """Whether ``x``, a python value or a column of them, is ``name``."""
    return x == name if isinstance(x, Column) else F.lit(x == name)


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def cell_status(value, tested, all_nn, metric, mode, threshold, ge=True) -> Column:
    """not_tested / nn / miss / hit for one cell (rule order matters).
    Metric, mode, threshold and ge are python values or columns."""
    v, t, a = _c(value), _c(tested), _c(all_nn)
    log = _is(metric, "log10_ic50")
    passed = F.when(_value(ge), v >= _value(threshold)).otherwise(v > _value(threshold))
    return (F.when(~F.coalesce(t, F.lit(False)), F.lit(NOT_TESTED))
            .when(log & F.coalesce(a, F.lit(False)), F.lit(NN))
            .when(v.isNull(), F.when(log, F.lit(NN)).otherwise(F.lit(NOT_TESTED)))
            .when(~log & (v <= 0), F.lit(NN))
            .when(_is(mode, "threshold") & ~passed, F.lit(MISS)).otherwise(F.lit(HIT)))


def cell_encoding(value, status, metric, mode) -> Column:
    """number drawn in the cell (threshold: 1 for hit; gradient: value for
    hit, 0.0 for nn; otherwise null)."""
    v, s = _c(value), _c(status)
    return F.when(_is(mode, "threshold"), F.when(s == HIT, F.lit(1.0))).otherwise(F.when(s == HIT, v).when(s == NN, F.lit(0.0)))


def cell_label(value, status, mode, show_values: bool = True) -> Column:
    """text drawn in the cell: ``0.00`` for nn, one decimal for a hit, rounded
    from the number's exact binary value (45.55 lies below the tie: ``45.5``)."""
    v, s = _c(value), _c(status)
    shown = F.lit(show_values) & ~_is(mode, "threshold")
    return F.when(s == NN, F.lit("0.00")).when(shown & (s == HIT) & v.isNotNull(), F.call_function("format_number", v, F.lit("0.0")))


def breadth_label(n_positive, n_tested) -> Column:
    """A7 as drawn beside a row: ``n/m``, nothing where no target was tested."""
    n, m = _c(n_positive), _c(n_tested)
    return F.when(m > 0, F.concat_ws("/", n.cast("string"), m.cast("string")))


def _py_number(x: float) -> str:
    """Python's str() of a float (``50.0``, ``75.5``)."""
    return repr(float(x))


def view_title(subgroup, bucket, metric: str, dilution, mode: str, threshold):
    """Single-view title; a column where the dose is one, else a string."""
    asked = "\0" if isinstance(dilution, Column) else int(float(dilution)) if metric == "pct_neut" else None
    dose = TITLE_DOSE_PCT.format(dose=asked) if metric == "pct_neut" else TITLE_DOSE_LOG
    thr = TITLE_THRESHOLD.format(thr=_py_number(threshold)) if mode == "threshold" else ""
    title = f"{subgroup}{TITLE_SEP}{bucket or TITLE_POOLED}{TITLE_SEP}{dose}{thr}"
    if metric != "pct_neut" or not isinstance(dilution, Column):
        return title
    before, after = title.split("\0")
    return F.concat(F.lit(before), dilution.cast("bigint").cast("string"), F.lit(after))


def multiple_title(sg, n_constructs, n_targets) -> Column:
    """Small-multiple title as a column expression."""
    fmt = TITLE_MULTIPLE.replace("{sg}", "%s").replace("{n}", "%d").replace("{m}", "%d")
    return F.format_string(fmt, _c(sg), _c(n_constructs), _c(n_targets))
