"""Adapter: raw events to per-service telemetry on a grid, plus truth and lifecycle intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.ranks import percentiles_of_counts
from telemetry_ops.functions.timeline import contiguous_runs
from telemetry_ops.grid import Grid

USERS_PER_SERVICE = 38
RATE_SCALE = 1_000_000

# Supported incident types.
INCIDENT_TYPES = ("cpu_saturation", "error_burst", "latency_spike", "memory_leak")


def service_of(user_id: str = "user_id"):
    """Users are grouped into services of equal size, so the fleet grows with the data."""
    return F.concat(F.lit("svc-"), F.expr(f"{user_id} div {USERS_PER_SERVICE}").cast("string"))


def telemetry_from_events(events: DataFrame, grid: Grid) -> DataFrame:
    """One row per service and step that saw events.

    Events are first reduced to one row per (service, step, value), with map-side combining, so a
    cell that holds a large share of all events reaches its final task as distinct values only.
    """
    is_error = (F.col("event_type") == "error").cast("int")
    k = F.get_json_object("props", "$.k").cast("bigint")
    reduced = (
        events.select(
            service_of().alias("service_id"),
            grid.step("ts").alias("step"),
            "value",
            is_error.alias("is_error"),
            k.alias("k"),
            "event_id",
        )
        .groupBy("service_id", "step", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("is_error").alias("errors"),
            F.sum("k").alias("k_sum"),
            F.max("k").alias("k_max"),
            F.max("event_id").alias("last_event"),
        )
    )
    cells = reduced.groupBy("service_id", "step").agg(
        F.sum("n").alias("n"),
        F.sum("errors").alias("errors"),
        F.sum("k_sum").alias("k_sum"),
        F.max("k_max").alias("k_max"),
        F.max("last_event").alias("last_event"),
        F.max("value").alias("value_max"),
        percentiles_of_counts("value", [0.5, 0.95], "n").alias("p"),
    )
    start = grid.time("step")
    return cells.select(
        "service_id",
        start.alias("timestamp"),
        "step",
        (F.col("n") / float(grid.step_seconds)).alias("request_rate_rps"),
        F.round(F.col("p")[0], 4).alias("latency_p50_ms"),
        F.round(F.col("p")[1], 4).alias("latency_p95_ms"),
        (F.col("errors") / F.col("n")).alias("error_rate"),
        (F.col("k_sum") / F.col("n")).alias("cpu_utilisation_pct"),
        F.col("k_max").cast("double").alias("memory_utilisation_pct"),
        F.col("value_max").alias("dependency_latency_ms"),
        F.timestamp_add(
            "SECOND", (grid.step_seconds + F.pmod("last_event", F.lit(97)) * 60).cast("bigint"), start
        ).alias("ingested_at"),
    )


def incidents_from_telemetry(telemetry: DataFrame, grid: Grid, level: float = 0.97) -> DataFrame:
    """Runs of steps whose error rate reaches the service's own high quantile.

    Error rates are fixed-point numbers with at most a million values, so their quantile is taken
    from counts of distinct values.
    """
    rated = telemetry.select(
        "service_id",
        "step",
        F.round(F.col("error_rate") * RATE_SCALE).cast("bigint").alias("rate"),
        "latency_p95_ms",
        "cpu_utilisation_pct",
    )
    limits = (
        rated.groupBy("service_id", "rate")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("service_id")
        .agg(percentiles_of_counts("rate", [level], "n")[0].alias("limit"))
    )
    high = rated.join(limits, "service_id").where(
        (F.col("rate") >= F.col("limit")) & (F.col("rate") > 0)
    )
    runs = contiguous_runs(
        high,
        ["service_id"],
        "step",
        grid.chunk_points,
        {
            "rate": F.col("rate"),
            "p95": F.col("latency_p95_ms"),
            "cpu": F.col("cpu_utilisation_pct"),
        },
    )
    start, end = F.col("start_step"), F.col("start_step") + F.col("length")
    return runs.select(
        F.concat_ws("-", "service_id", start.cast("string")).alias("incident_id"),
        "service_id",
        F.when(F.col("p95") >= 60, "latency_spike")
        .when(F.col("cpu") >= 60, "cpu_saturation")
        .otherwise("error_burst")
        .alias("incident_type"),
        grid.time(start - 2).alias("precursor_start"),
        grid.time(start).alias("incident_start"),
        grid.time(end).alias("incident_end"),
        grid.time(end + 1).alias("recovery_end"),
        (0.5 + F.col("rate") / RATE_SCALE).alias("severity"),
    )


