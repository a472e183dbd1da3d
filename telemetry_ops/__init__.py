"""Spark operators for incident forecasting on service telemetry."""

from telemetry_ops.grid import Grid

__all__ = ["Grid"]
