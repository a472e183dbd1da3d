"""The time grid every operator is parameterised by, and the telemetry column contract."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric columns in contract order, statistics in feature order.
METRICS = (
    "request_rate_rps",
    "latency_p50_ms",
    "latency_p95_ms",
    "error_rate",
    "cpu_utilisation_pct",
    "memory_utilisation_pct",
    "dependency_latency_ms",
)
STATISTICS = ("current", "mean", "std", "min", "max", "change", "slope")

FEATURES = tuple(f"{metric}__{stat}" for metric in METRICS for stat in STATISTICS)
TARGET = "incident_within_horizon"
KEY = ("service_id", "timestamp")

SECOND = 1_000_000
DAY = 86_400 * SECOND


@dataclass(frozen=True)
class Grid:
    """Rows lie on ``origin + k * step``; windows are ``(t-W, t]``, horizons ``(t, t+H]``.

    ``chunk_points`` is the length of the time chunks that windows are split into, so that one
    long-lived service is worked on by many tasks. It never changes a result.
    """

    origin: datetime
    step_seconds: int = 60
    window_seconds: int = 15 * 60
    horizon_seconds: int = 10 * 60
    chunk_points: int = 1440

    def __post_init__(self):
        if min(self.step_seconds, self.window_seconds, self.horizon_seconds) <= 0:
            raise ValueError("Step, window and horizon must be positive")
        if self.chunk_points < 1:
            raise ValueError("Chunks need at least one point")

    @property
    def step_us(self) -> int:
        return self.step_seconds * SECOND

    @property
    def phase_us(self) -> int:
        """Where grid points lie between two steps counted from the epoch."""
        since = self.origin - datetime(1970, 1, 1)
        return (since // timedelta(microseconds=1)) % self.step_us

    @property
    def window_us(self) -> int:
        return self.window_seconds * SECOND

    @property
    def horizon_us(self) -> int:
        return self.horizon_seconds * SECOND

    @property
    def window_points(self) -> int:
        return math.ceil(self.window_seconds / self.step_seconds)

    @property
    def horizon_points(self) -> int:
        return math.ceil(self.horizon_seconds / self.step_seconds)

    @property
    def chunk_us(self) -> int:
        return self.chunk_points * self.step_us

    def _origin(self) -> Column:
        return moment(self.origin)

    def us(self, timestamp: Column | str) -> Column:
        """Microseconds since the origin (the session time zone must be UTC)."""
        column = F.col(timestamp) if isinstance(timestamp, str) else timestamp
        return F.timestamp_diff("MICROSECOND", self._origin(), column)

    def step(self, timestamp: Column | str) -> Column:
        """Number of whole steps since the origin."""
        return floor_div(self.us(timestamp), self.step_us)

    def on_grid(self, timestamp: Column | str) -> Column:
        return F.pmod(self.us(timestamp), F.lit(self.step_us)) == 0

    def time(self, step: Column | str) -> Column:
        """Zone-free timestamp of a step number."""
        column = F.col(step) if isinstance(step, str) else step
        return F.timestamp_add("SECOND", (column * self.step_seconds).cast("bigint"), self._origin())


def moment(value: datetime | Column) -> Column:
    """A zone-free timestamp; Python datetimes go through text, so no local zone can shift them."""
    if isinstance(value, Column):
        return value
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def floor_div(value: Column, by: int) -> Column:
    """Exact floor division of bigints (``floor(a/b)`` would go through doubles)."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))
