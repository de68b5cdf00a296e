"""spindrift: a PySpark-native graph-analytics engine."""

from __future__ import annotations

__version__ = "0.1.0"
