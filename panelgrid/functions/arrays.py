"""Dose / response array expressions (X4, X5, X11) — higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DOSE_TOLERANCE
from .text import SPACES, _c, as_text, ustrip

# One numeric literal as the dashboard's literal parser accepts it: optional sign,
# decimal int without leading zeros (or zeros only), float with fraction and/or
# exponent.  No underscores, quotes, names or hex.
_E = (
    r"(?:[+-]\s*)?(?:\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?"
    r"|\d+[eE][+-]?\d+|0+|[1-9]\d*)"
)
ELEMENT_RE = "^" + _E + "$"
# Sheet text as it usually comes: a list or tuple of plain decimals.  It keeps to the
# grammar as a whole, so its elements need no look of their own.  (Possessive: a text
# of any length is matched without recursion.)
_D = r"-?\d++\.\d++"
PLAIN_RE = rf"^(?:\[{_D}(?:, ?{_D})*+\]|\({_D}(?:, ?{_D})*+,\))\z"
NP_WRAP_RE = r"np\.float64\(([^)]+)\)"


def array_text(c) -> Column:
    """X4 step 1: stripped sheet text with ``np.float64(x)`` wrappers removed."""
    return _unwrapped(ustrip(as_text(c)))


def _unwrapped(text: Column) -> Column:
    # Bound by a one-element transform: most texts hold no wrapper and skip the expression.
    return F.transform(F.array(text), lambda t: F.when(t.contains("np.float64("), F.regexp_replace(t, NP_WRAP_RE, "$1")).otherwise(t))[0]


def _trimmed(t: Column) -> Column:
    # Before a last line end that is no ``\\s``, ``$`` matches too: only the expression knows that.
    odd = t.contains("\x85") | t.contains("\u2028") | t.contains("\u2029")
    return F.when(odd, F.regexp_replace(t, r"^\s+|\s+$", "")).otherwise(F.btrim(t, F.lit(SPACES)))


def parse_array_text(s) -> Column:
    """X4 step 2: parse normalised text (see ``array_text``) into array<double>.

    Text outside the grammar gives an empty array, never null.  Inside the
    grammar every element is a decimal literal, so the casts cannot fail.
    """
    s = _c(s)
    first, last = F.left(s, F.lit(1)), F.right(s, F.lit(1))
    is_list, is_tuple = (first == "[") & (last == "]"), (first == "(") & (last == ")")
    wrapped = (is_list | is_tuple) & (F.length(s) >= 2)
    body = F.when(wrapped, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    parts = F.transform(F.split(body, ","), _trimmed)

    def checked(of: Column) -> Column:
        # One comma may follow the last element; brackets aside, a lone element needs it.
        trailing = (F.size(of) > 1) & (F.get(of, F.size(of) - 1) == "")
        items = F.when(trailing, F.slice(of, F.lit(1), F.size(of) - 1)).otherwise(of)
        none = wrapped & (F.size(of) == 1) & (F.get(of, F.lit(0)) == "")
        shaped = is_list | (F.size(of) > 1)
        fine = shaped & ~none & F.forall(items, lambda t: t.rlike(ELEMENT_RE))
        nums = F.transform(items, lambda t: F.translate(t, SPACES, "").cast("double"))
        return F.when(fine, nums).otherwise(F.array().cast("array<double>"))

    plain = F.split(F.translate(F.btrim(s, F.lit("[](),")), " ", ""), ",").cast("array<double>")
    # A one-element transform, so that the split is made once.
    return F.when(s.rlike(PLAIN_RE), plain).otherwise(F.coalesce(F.transform(F.array(parts), checked)[0], F.array().cast("array<double>")))


def parse_array(c) -> Column:
    """Parse list / tuple / bare comma text into array<double>.

    ``np.float64(x)`` wrappers are unwrapped first; any text outside the
    grammar (names, nested lists, empty elements, ...) gives an empty array.
    For wide scans prefer ``array_text`` in one projection and
    ``parse_array_text`` in the next, so the text is normalised once.
    """
    return parse_array_text(array_text(c))


_PAIR_T = "array<struct<d:double,n:double>>"


def _zip(dil: Column, neut: Column) -> Column:
    """(d, n) pairs, padded with nulls to the longer array.

    Both arrays are direct arguments (never referenced inside a lambda), so
    the optimizer cannot inline their parse into a per-element evaluation."""
    return F.arrays_zip(dil, neut).cast(_PAIR_T)


def value_at_dose(dil, neut, dose, tol: float = DOSE_TOLERANCE) -> Column:
    """Response at the first dose within ``tol`` (strict); arrays must be
    non-empty and of equal length, else null."""
    d, n = _c(dil), _c(neut)
    target = dose if isinstance(dose, Column) else F.lit(float(dose))
    hit = F.get(F.filter(_zip(d, n), lambda p: F.abs(p["d"] - target) < tol), 0)
    return F.when((F.size(d) > 0) & (F.size(d) == F.size(n)), hit["n"])


def pairs_shortest(dil, neut) -> Column:
    """(d, n) pairs zipped to the shorter array (no length check)."""
    d, n = _c(dil), _c(neut)
    return F.slice(_zip(d, n), 1, F.least(F.size(d), F.size(n)))


def pairs_equal(dil, neut) -> Column:
    """Curve pairs: only rows whose arrays are non-empty and of equal length."""
    d, n = _c(dil), _c(neut)
    empty = F.array().cast(_PAIR_T)
    return F.when((F.size(d) > 0) & (F.size(d) == F.size(n)), _zip(d, n)).otherwise(empty)
