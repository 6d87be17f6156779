"""Dose-response curves (A11, F10, W6): mean response per dose.

All (construct, target) curves are computed in one pass: rows with equal,
non-empty arrays are exploded into (dose, response) pairs and aggregated by
(construct, target, dose) with a partial aggregation.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import pairs_equal
from ..functions.exact import mean, sum_parts

C, T = "Construct_Description", "PSV"


def curves(tidy: DataFrame, construct: Optional[str] = None, target: Optional[str] = None,
           buckets: Optional[Sequence[str]] = None) -> DataFrame:
    """(construct, target, dilution, pct_neut, n_points) for every pair, or one
    pair when ``construct`` / ``target`` are given.  No bucket filter unless
    ``buckets`` is given (rows of any bucket count)."""
    d = tidy
    if construct is not None:
        d = d.filter(F.col(C) == construct)
    if target is not None:
        d = d.filter(F.col(T) == target)
    if buckets:
        d = d.filter(F.col("Bucket_Type").isin(*buckets))
    pairs = d.select(C, T, F.explode(pairs_equal("DilutionArray", "NeutArray")).alias("p"))
    return (pairs.groupBy(C, T, F.col("p")["d"].alias("dilution"))
            .agg(*sum_parts(F.col("p")["n"], "v")).select(C, T, "dilution", mean("v").alias("pct_neut"), F.col("v_n").alias("n_obs")))
