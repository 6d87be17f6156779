"""panelgrid — Spark-native dose-response panel analytics."""

from .config import Rules, ViewSpec

__all__ = ["Rules", "ViewSpec"]
