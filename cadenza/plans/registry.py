"""All queries of the engine itself and their DuckDB SQL."""

from __future__ import annotations

from cadenza.plans import sessions_timing, sources_metrics, alignment_models, live_requests  # noqa: F401  they register their queries
from cadenza.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
