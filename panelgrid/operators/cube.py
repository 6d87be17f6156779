"""The cell × dose cube: one aggregate of the tidy rows that answers every view.

A row of the cube holds, for one (experiment, group, bucket, construct, target)
and one dose, the parts of three exact sums with their counts:

* ``first``  the response of the first element at this dose (views at one dose);
* ``pair``   every (dose, response) pair, arrays cut to the shorter (all doses);
* ``equal``  pairs of rows whose arrays are equally long (curves).

Rows with a null dose carry the potency: ``n_rows``, ``n_nn`` and the parts of
``log``.  All sums are exact (``functions.exact``), so a view taken from the cube
equals the view taken from the rows, whatever selection it makes of the keys.

A view asks for the first element *within a tolerance* of a dose.  Where doses of
one row lie so near to each other that two could answer, the row's pairs are kept
as they are in ``rest`` (equal arrays counted once) and the match is made when the
dose is known; nothing is approximated.

The step is a projection, an explode to 1 + (number of doses) entries and one hash
aggregation with a map-side step, so a construct with a third of all rows ships
partial sums only.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_DOSES, DOSE_TOLERANCE, FALLBACK_DOSE
from ..functions.exact import PARTS, add_parts, mean, part_names, parts, sum_parts

ROW_KEYS = ["Experiment", "Group", "Bucket_Type", "Construct_Description", "PSV"]
VIEW_KEYS = ["Bucket_Type", "Construct_Description", "PSV"]
MEASURES = ("first", "pair", "equal", "log")
#: Doses of a row nearer than this could both answer one request (with room for rounding).
NEAR = 2 * DOSE_TOLERANCE * (1 + 1e-6)

_ENTRY = "struct<dose:double,first:double,pair:double,equal:double,log:double,row:bigint,nn:bigint,rest:array<struct<d:double,n:double>>>"


def _entries(tidy: DataFrame) -> DataFrame:
    """Each tidy row's potency entry, dose entries and, where doses are near, its pairs."""
    d, n = F.col("DilutionArray"), F.col("NeutArray")
    rising = F.array_sort(F.array_distinct(d))
    gaps = F.arrays_zip(F.slice(rising, 1, F.greatest(F.size(rising) - 1, F.lit(0))).alias("x"),
                        F.slice(rising, 2, F.greatest(F.size(rising) - 1, F.lit(0))).alias("y"))
    even = (F.size(d) == F.size(n)) & (F.size(d) > 0)
    # Whole arrays stand side by side; no lambda refers to another array, which
    # Catalyst could replace by the parse of its text for every element.
    rows = tidy.select(*ROW_KEYS, "Is_NN", "Log10_IC50", "DilutionArray", "NeutArray", even.alias("_even"),
                       (even & F.exists(gaps, lambda g: g["y"] - g["x"] < NEAR)).alias("_near"))
    none = F.array().cast("array<double>")
    equal = F.when(F.col("_even"), n).otherwise(none)
    zipped = F.slice(F.arrays_zip(d.alias("d"), n.alias("n"), equal.alias("e"), F.when(~F.col("_near"), equal).otherwise(none).alias("f")), 1, F.size(d))
    placed = F.array_sort(F.transform(zipped, lambda p, i: F.struct(p["d"].alias("d"), i.alias("i"), p["n"].alias("n"), p["e"].alias("e"), p["f"].alias("f"))))
    rows = rows.select("*", placed.alias("_placed"))
    # By dose, then place: an element is the first of its dose unless the one before it has the same.
    before = F.slice(F.concat(F.array(F.lit(None).cast("double")), F.transform("_placed", lambda p: p["d"])), 1, F.size("_placed"))
    dosed = F.transform(F.arrays_zip(F.col("_placed").alias("p"), before.alias("q")), lambda z: F.struct(
        z["p"]["d"].alias("dose"), F.when(z["q"].isNull() | (z["q"] != z["p"]["d"]), z["p"]["f"]).alias("first"), z["p"]["n"].alias("pair"),
        z["p"]["e"].alias("equal"), F.lit(None).cast("double").alias("log"), F.lit(0).cast("bigint").alias("row"),
        F.lit(0).cast("bigint").alias("nn"), F.lit(None).cast("array<struct<d:double,n:double>>").alias("rest")))
    nothing = F.lit(None).cast("double")
    pairs = F.arrays_zip(d.alias("d"), n.alias("n")).cast("array<struct<d:double,n:double>>")
    own = F.struct(nothing.alias("dose"), nothing.alias("first"), nothing.alias("pair"), nothing.alias("equal"), F.col("Log10_IC50").alias("log"),
                   F.lit(1).cast("bigint").alias("row"), F.coalesce(F.col("Is_NN").cast("bigint"), F.lit(0)).alias("nn"), F.when(F.col("_near"), pairs).alias("rest"))
    entries = F.concat(F.array(own.cast(_ENTRY)), dosed.cast(f"array<{_ENTRY}>"))
    return rows.select(*ROW_KEYS, F.inline(entries))


def build_cube(tidy: DataFrame) -> DataFrame:
    """The cube of tidy rows (every bucket, ``Unknown`` too)."""
    return _entries(tidy).groupBy(*ROW_KEYS, "dose", "rest").agg(
        F.sum("row").alias("n_rows"), F.sum("nn").alias("n_nn"), *[c for m in MEASURES for c in sum_parts(m, m)])


def default_dose(cube: DataFrame) -> Column:
    """F13 as a scalar subquery: 90 if present, else 30, else the smallest dose, else 30."""
    found = [F.when(F.max(F.col("dose") == x), F.lit(float(x))) for x in DEFAULT_DOSES]
    return cube.where("dose IS NOT NULL").agg(F.coalesce(*found, F.min("dose"), F.lit(float(FALLBACK_DOSE))).alias("dose")).scalar()


def _at_dose(cube: DataFrame, dose) -> DataFrame:
    """Parts ``first_*`` of the responses that answer ``dose`` (a number or a column)."""
    asked = cube.withColumn("_asked", dose if isinstance(dose, Column) else F.lit(float(dose)))
    here = F.abs(F.col("dose") - F.col("_asked")) < DOSE_TOLERANCE
    hit = F.get(F.filter("rest", lambda p: F.abs(p["d"] - F.col("_asked")) < DOSE_TOLERANCE), 0)["n"]
    asked = asked.where(here | F.col("rest").isNotNull()).withColumn("_hit", hit)
    late = parts("_hit", "n_rows")
    return asked.withColumns({f"first_{p}": F.when(F.col("dose").isNull(), late[p]).otherwise(F.col(f"first_{p}")) for p in PARTS})


def cube_view(cube: DataFrame, metric: str, dilution=None, buckets: Sequence[str] = ("Prime", "Boost1", "Boost2"),
              extra_keys: Sequence[str] = ()) -> DataFrame:
    """A1 (one dose), A2 (all doses), A3 (log10 potency) from the cube, with the
    columns of ``view.compute_view``; rows may be selected by any key before."""
    keys = [*extra_keys, *VIEW_KEYS]
    c = cube.where(F.col("Bucket_Type").isin(*buckets))
    if metric == "log10_ic50":
        g = c.where("dose IS NULL").groupBy(*keys).agg(F.sum("n_rows").alias("n_tested"), F.sum("n_nn").alias("n_nn"), *add_parts("log"))
        all_nn = F.col("n_nn") == F.col("n_tested")
        return g.select(*keys, F.when(~all_nn, mean("log")).alias("value"), "n_tested", all_nn.alias("all_nn"))
    if metric != "pct_neut":
        raise ValueError(f"unknown metric {metric!r}")
    if dilution is None:
        raise ValueError("a percent view needs a dose: pass a number, a column or 'all'")
    if isinstance(dilution, str):
        measure, c = "pair", c.where("dose IS NOT NULL")
    else:
        measure, c = "first", _at_dose(c, dilution)
    g = c.groupBy(*keys).agg(*add_parts(measure)).where(F.col(f"{measure}_n") > 0)
    return g.select(*keys, mean(measure).alias("value"), F.col(f"{measure}_n").alias("n_tested"), F.lit(False).alias("all_nn"))


def cube_curves(cube: DataFrame) -> DataFrame:
    """A11 from the cube: (construct, target, dilution, pct_neut, n_obs)."""
    c = cube.where("dose IS NOT NULL AND equal_n > 0").groupBy("Construct_Description", "PSV", F.col("dose").alias("dilution")).agg(*add_parts("equal"))
    return c.select("Construct_Description", "PSV", "dilution", mean("equal").alias("pct_neut"), F.col("equal_n").alias("n_obs"))


__all__ = ["build_cube", "cube_curves", "cube_view", "default_dose", "part_names"]
