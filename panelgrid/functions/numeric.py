"""Numeric parsing expressions.

Spark 4 runs with ANSI mode on, so every text→number conversion goes through
``try_cast`` behind a strict decimal-literal pattern: this keeps Spark-only
spellings (``1.0d``, ``Infinity``) and text like ``nan`` out, and makes the
result the same in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NN_TOKENS_VARIANT
from .text import _c, as_text, is_blank_token, ustrip

# A plain decimal literal: sign, digits with optional fraction, optional exponent.
NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(c) -> Column:
    """Strict number parse of stripped text (null when not a decimal literal)."""
    s = ustrip(c)
    return F.when(s.rlike(NUMBER_RE), s.try_cast("double"))


def to_float(c) -> Column:
    """Tolerant potency parse; thousands separators removed."""
    return parse_number(F.translate(ustrip(as_text(c)), ",", ""))


def is_nn(c) -> Column:
    """X6: "no response" token, or a number equal to zero."""
    num = to_float(c)
    return is_blank_token(as_text(c)) | F.coalesce(num == 0.0, F.lit(False))


def log10_pos(c) -> Column:
    """log10 of positive values only (null otherwise)."""
    x = _c(c)
    return F.when(x > 0, F.log10(x))


def day_number(c) -> Column:
    """Numeric day (null when not a number)."""
    return parse_number(as_text(c))


def day_int(c) -> Column:
    """Day truncated toward zero (null when absent or out of range)."""
    return _c(c).try_cast("bigint")


def parse_potency_variant(c) -> Column:
    """(log10, nn flag); unparsable or non-positive text gives (0.0, true)."""
    s = F.upper(ustrip(as_text(c)))
    v = to_float(s)
    nn = s.isin(*NN_TOKENS_VARIANT) | v.isNull() | (v <= 0)
    return F.struct(
        F.when(nn, F.lit(0.0)).otherwise(F.log10(v)).alias("log10"),
        nn.alias("is_nn"),
    )
