"""Sums and means that do not depend on the order of the rows.

A floating-point sum rounds at every step, so its last bits follow the order in
which partial sums meet, and two evaluations of one plan may rank or classify a
row differently.  Here a number is cut into whole limbs (its floor, and two of
30 bits below the point), limbs are added as longs, and one fixed formula turns
the three sums into a double.  Parts of parts add up to the same sums, so means
taken from a pre-aggregated table equal those of the rows bit for bit.

Numbers below 2^-60 of a unit lose what lies below that; numbers of 2^52 or more
have no fraction and are added as doubles.  A limb's sum overflows a long beyond
some 8 billion rows of one group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

LIMB = float(2 ** 30)
#: Numbers from here on have no binary places behind the point.
WHOLE = float(2 ** 52)
PARTS = ("n", "i", "a", "g", "b")


def parts(x, weight=None) -> dict[str, Column]:
    """The limbs of ``x``, each times ``weight`` (a whole number), nulls where ``x`` is null."""
    x = _c(x)
    times = F.lit(1).cast("long") if weight is None else _c(weight)
    small = F.when(F.abs(x) < WHOLE, x)
    i = F.floor(small)
    first = (small - i) * LIMB
    a = F.floor(first)
    return {"n": F.when(x.isNotNull(), times), "i": i * times, "a": a * times, "g": F.floor((first - a) * LIMB) * times,
            "b": F.when(F.abs(x) >= WHOLE, x * times)}


def sum_parts(x, name: str) -> list[Column]:
    """Aggregates ``name_n``, ``name_i``, ... of a number."""
    return [F.sum(c).alias(f"{name}_{p}") for p, c in parts(x).items()]


def add_parts(name: str, into: str | None = None) -> list[Column]:
    """Aggregates of parts that were aggregated before."""
    return [F.sum(f"{name}_{p}").alias(f"{into or name}_{p}") for p in PARTS]


def part_names(name: str) -> list[str]:
    return [f"{name}_{p}" for p in PARTS]


def total(name: str) -> Column:
    """The sum as a double; null where there was no number."""
    i, a, g, b = (F.col(f"{name}_{p}") for p in PARTS[1:])
    low = F.coalesce(i.cast("double") + (a.cast("double") + g.cast("double") / LIMB) / LIMB, F.lit(0.0))
    return F.when(F.col(f"{name}_n") > 0, low + F.coalesce(b, F.lit(0.0)))


def mean(name: str) -> Column:
    return total(name) / F.col(f"{name}_n").cast("double")
