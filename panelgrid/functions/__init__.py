"""Column expressions (scalar functions X1-X15, F11, F14)."""

from .arrays import array_text, pairs_equal, pairs_shortest, parse_array, parse_array_text, value_at_dose
from .hill import hill4pl, logspace_points
from .numeric import (day_int, day_number, is_nn, log10_pos, parse_number,
                      parse_potency_variant, to_float)
from .status import cell_encoding, cell_label, cell_status, multiple_title, view_title
from .text import as_text, cohort_id, cohort_key, norm_name, rsearch, ustrip

__all__ = [
    "as_text", "cell_encoding", "cell_label", "cell_status", "cohort_id", "cohort_key",
    "day_int", "day_number", "hill4pl", "is_nn", "log10_pos", "logspace_points",
    "multiple_title", "norm_name", "pairs_equal", "pairs_shortest", "parse_array",
    "parse_number", "parse_potency_variant", "rsearch", "to_float", "ustrip",
    "value_at_dose", "view_title",
]
