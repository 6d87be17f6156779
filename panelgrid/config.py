"""Rule tables, view specification and fixed values.

Everything domain specific (cohort filters, dose-window map, classification
rules, label overrides, target genotypes, panels) is *data* handed to the
engine through :class:`Rules`; nothing about a particular study is baked in.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Optional, Sequence, Union

# ---------------------------------------------------------------------------
# Fixed values.  These must stay exactly as written for results to agree with
# the dashboard semantics the engine reproduces (tokens, labels, formats).
# ---------------------------------------------------------------------------

# Potency cell texts that mean "no response" (compared after strip + lower).
NN_TOKENS = ("nn", "no neutralization", "no neut", "", "nan", "none", "-", "na", "n/a")
# Potency texts that the variant parser (X10) treats as "no response" (after strip + upper).
NN_TOKENS_VARIANT = ("NN", "", "N/A", "NA", "NAN", "NONE", "-", "0")
# Cell statuses.
HIT, MISS, NN, NOT_TESTED = "hit", "miss", "nn", "not_tested"
# Bucket label used when the dose-window map has no entry (or the day is not a number).
UNKNOWN_BUCKET = "Unknown"
# Subgroup wildcard meaning "no subgroup filter".
ALL_CONSTRUCTS = "All constructs"
# Genotype used for targets missing from the genotype table when ordering columns.
NO_GENOTYPE = "zzz"
# Dose tolerance for "value at dilution".
DOSE_TOLERANCE = 0.01
# Preferred default doses, in order, then the smallest present, then 30.
DEFAULT_DOSES = (90.0, 30.0)
FALLBACK_DOSE = 30.0
# Threshold presets per metric; the first is the default.
THRESHOLD_PRESETS = {"pct_neut": (50.0, 75.0), "log10_ic50": (3.0, 3.5)}
# Curve threshold line: the threshold for % metric, else 50.
CURVE_THRESHOLD_OTHER = 50.0
# Top-N size per subgroup.
TOP_N = 4
# Four-parameter logistic fit: minimum points, effort cap, line resolution,
# parameter bounds (top, bottom) and ic50 bounds as multiples of min / max dose,
# slope bounds, and the span of the fitted line (multiples of min / max dose).
FIT_MIN_POINTS = 4
FIT_MAX_EVALS = 8000
FIT_LINE_POINTS = 300
FIT_TOP_BOUNDS = (0.0, 120.0)
FIT_BOTTOM_BOUNDS = (-10.0, 100.0)
FIT_IC50_FACTORS = (0.01, 100.0)
FIT_SLOPE_BOUNDS = (0.1, 10.0)
FIT_LINE_SPAN = (0.5, 2.0)
# Titles.  "{sg}  ·  {bucket}  ·  {dose}{thr}" for a single view,
# "{sg}  ·  {n} constructs × {m} PSVs" for a small multiple.
TITLE_DOSE_PCT = "% neut @ 1:{dose}"
TITLE_DOSE_LOG = "log₁₀(IC50)"
TITLE_POOLED = "All (pooled)"
TITLE_SEP = "  ·  "
TITLE_THRESHOLD = "  ·  ≥{thr}"
TITLE_MULTIPLE = "{sg}  ·  {n} constructs × {m} PSVs"

# Header patterns used to find the measurement-sheet columns (first pattern
# wins, then column order; case-insensitive search).
HEADER_PATTERNS = {
    "sample": (r"sample.?type",),
    "group": (r"^group$", r"\bgroup\b"),
    "psvx": (r"psvx.?no", r"psvx_no", r"^psvx"),
    "psv": (r"^psv$", r"\bpseudovirus\b"),
    "day": (r"^day$", r"\bday\b"),
    "experiment": (r"^experiment$", r"\bexperiment\b", r"pvxe"),
    "desc": (r"construct.?description", r"\bconstruct\b", r"immunogen"),
    "dilution": (r"dilution",),
}
IC50_CORRECTED_PATTERNS = (r"^ic50_corrected$", r"ic50.?corrected", r"corrected.?ic50")
IC50_RAW_PATTERNS = (r"^ic50$",)
IC50_FALLBACK_PATTERNS = (r"ic50",)
NEUT_CORRECTED_PATTERNS = (r"^avg_neut_percent_corrected$", r"avg.?neut.?percent.?corrected")
NEUT_RAW_PATTERNS = (r"^avg_neut_percent$",)
NEUT_FALLBACK_PATTERNS = (r"avg.?neut.?percent", r"neutrali")


def sheet_roles(corrected: bool) -> dict[str, tuple[str, ...]]:
    """Ordered header patterns of every role of a measurement sheet."""
    ic50, neut = ((IC50_CORRECTED_PATTERNS, NEUT_CORRECTED_PATTERNS) if corrected
                  else (IC50_RAW_PATTERNS, NEUT_RAW_PATTERNS))
    return HEADER_PATTERNS | {"ic50": ic50 + IC50_FALLBACK_PATTERNS, "neut": neut + NEUT_FALLBACK_PATTERNS}


# Constructs sheet headers.
CONSTRUCT_HEADER_PATTERNS = {
    "program": (r"^program$",),
    "psvx": (r"psvx.?id|psvx.?no|^psvx$",),
    "group": (r"^group$",),
    "desc": (r"construct.?desc",),
}

# Largest rule / dimension table we are willing to broadcast (rows).
MAX_BROADCAST_ROWS = 200_000

RuleTable = Union[Sequence[tuple], Any]  # python rows or a pyspark DataFrame


@dataclass(frozen=True)
class Rules:
    """User supplied cohort filters and rule tables.

    Each table is either a sequence of tuples (small configuration) or a
    DataFrame with the listed columns.
    """

    drop_sample_types: tuple[str, ...] = ()
    drop_groups: tuple[str, ...] = ()
    keep_experiments: Optional[tuple[str, ...]] = None
    buckets: tuple[str, ...] = ("Prime", "Boost1", "Boost2")
    uncategorized: str = "Uncategorized"
    subgroup_order: tuple[str, ...] = ()
    # (experiment, psvx, day:int, bucket)
    bucket_map: RuleTable = ()
    # (name, subgroup) — later rows win when names collide after normalisation
    exact_map: RuleTable = ()
    # (pattern, subgroup) — ordered, first match wins, case-insensitive search;
    # a DataFrame has (ordinal, pattern, subgroup) with unique ordinals
    pattern_rules: RuleTable = ()
    # (experiment, group, bucket, label)
    label_overrides: RuleTable = ()
    # target -> genotype
    target_groups: dict = field(default_factory=dict)
    # Program value kept from the constructs sheet (None = keep all rows)
    program: Optional[str] = None
    max_broadcast_rows: int = MAX_BROADCAST_ROWS


@dataclass(frozen=True)
class ViewSpec:
    """One dashboard request: metric, dose, encoding, filters and ordering."""

    metric: str = "pct_neut"  # or "log10_ic50"
    dilution: Union[float, str, None] = None  # a dose, "all", or None (default rule)
    mode: str = "gradient"  # "gradient" | "threshold" | "none"
    threshold: Optional[float] = 50.0
    ge: Optional[bool] = True
    bucket: Optional[str] = None  # None / "All" = pooled
    subgroup: str = ALL_CONSTRUCTS
    sort_by: str = "breadth"  # or "mean_value"
    sort_descending: bool = True
    experiments: Optional[tuple[str, ...]] = None  # None / empty = all known
    groups: Optional[tuple[str, ...]] = None
    targets: Optional[tuple[str, ...]] = None
    use_genotype: bool = False
    corrected: bool = True
    # Parity with the HTTP handlers: an empty group selection means "all known
    # non-blank groups", which drops blank-group rows when any group exists.
    default_group_filter: bool = True

    # The other front end's reading of lists: an empty experiment or target
    # selection keeps no rows, an empty group selection filters nothing.
    empty_is_none: bool = False

    @classmethod
    def for_metric(cls, metric: str, preset: int = 0, **more) -> "ViewSpec":
        """A spec with the metric's preset threshold (the first one is the default)."""
        return cls(metric=metric, threshold=THRESHOLD_PRESETS[metric][preset], **more)

    def curve_threshold(self) -> float:
        if self.metric == "pct_neut":
            return 50.0 if self.threshold is None else float(self.threshold)
        return CURVE_THRESHOLD_OTHER
