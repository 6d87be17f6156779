"""Sources and sinks: CSV sheets, column resolution, assay sheets derived
from the driver tables."""

from .assay import constructs_sheet, demo_rules, measurement_sheet, table
from .sheets import (CSV_OPTIONS, SheetColumns, match_headers, read_sheet, resolve_columns,
                     resolve_construct_columns, select_resolved, write_sheet)

__all__ = [
    "CSV_OPTIONS", "SheetColumns", "constructs_sheet", "demo_rules", "match_headers",
    "measurement_sheet", "read_sheet", "resolve_columns", "resolve_construct_columns",
    "select_resolved", "table", "write_sheet",
]
