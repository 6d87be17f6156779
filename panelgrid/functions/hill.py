"""Four-parameter logistic expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def hill4pl(x, top, bottom, ic50, slope) -> Column:
    """Bottom + (top - bottom) / (1 + (x / ic50) ** slope)."""
    x, top, bottom, ic50, slope = (_c(v) if not isinstance(v, (int, float)) else F.lit(float(v))
                                   for v in (x, top, bottom, ic50, slope))
    return bottom + (top - bottom) / (F.lit(1.0) + F.pow(x / ic50, slope))


def logspace_points(lo, hi, n: int) -> Column:
    """Array of ``n`` log-spaced points from ``lo`` to ``hi`` (inclusive)."""
    lo, hi = _c(lo), _c(hi)
    a, b = F.log10(lo), F.log10(hi)
    step = (b - a) / F.lit(float(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.pow(F.lit(10.0), a + i.cast("double") * step))
