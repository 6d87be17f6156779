"""Text column expressions (X1, X2, X3, X15).  All JVM-side, codegen friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NN_TOKENS


#: ``\\s`` of a regular expression, and of one with Unicode classes (White_Space).
SPACES = "\t\n\x0b\f\r "
UNICODE_SPACES = SPACES + "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Strip Unicode whitespace at both ends (``trim`` keeps NBSP)."""
    return F.btrim(_c(c), F.lit(UNICODE_SPACES))


def as_text(c) -> Column:
    """Sheet text of a cell: null becomes the empty string."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def norm_name(c) -> Column:
    """Collapse whitespace, lower-case, drop spaces next to ``_``."""
    s = F.lower(ustrip(F.regexp_replace(_c(c), r"(?U)\s+", " ")))
    s = F.regexp_replace(s, r"(?U)\s+_", "_")
    return F.regexp_replace(s, r"(?U)_\s+", "_")


def cohort_id(c) -> Column:
    """Cohort id cleanup as done on the measurement sheet.

    Drops every ``psvx`` / ``psvx-`` (any case), the ``(C)`` / ``(R)`` tags with
    surrounding spaces, then strips.  Case is kept.
    """
    s = F.regexp_replace(ustrip(c), r"(?i)psvx-?", "")
    s = F.regexp_replace(s, r"(?U)\s*\([CRrc]\)\s*", "")
    return ustrip(s)


def cohort_key(c) -> Column:
    """X3 variant used by the constructs lookup: upper-cased cohort id."""
    return F.upper(cohort_id(c))


def rsearch(c, pattern: str) -> Column:
    """Case-insensitive, Unicode-aware regex search anywhere in the text."""
    return _c(c).rlike("(?iu)" + pattern)


def is_blank_token(c) -> Column:
    """True when the stripped, lower-cased text is one of the "no value" tokens."""
    return F.lower(ustrip(c)).isin(*NN_TOKENS)
