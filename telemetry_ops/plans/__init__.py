"""Ready-made queries over the given tables, each with its SQL counterpart where one exists."""

from telemetry_ops.plans import checks, files, models, monitoring, scoring, streams, summaries, windows  # noqa: F401  (they register queries)
from telemetry_ops.plans.registry import QUERIES, full_sql

__all__ = ["QUERIES", "full_sql"]
