"""Structured Streaming counterparts of the batch views."""

from .live import cell_aggregates, sheet_stream, start_live_cells, view_from_cells

__all__ = ["cell_aggregates", "sheet_stream", "start_live_cells", "view_from_cells"]
