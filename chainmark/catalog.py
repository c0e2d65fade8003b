"""The registered queries of the analytics operators."""

from __future__ import annotations

from .plans import adjustments, analytics, calibration, evaluation, features, flows, gates, joins, models, ordered, records, replays, shapes, sources  # noqa: F401
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
