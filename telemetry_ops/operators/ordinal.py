"""Scoring of ordinal matrices: rows are numbered per machine and have no calendar time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetry_ops.grid import Grid
from telemetry_ops.operators.episodes import operational_summary
from telemetry_ops.operators.scores import row_metrics


def step_grid(window: int, horizon: int, chunk: int = 1440) -> Grid:
    """A grid whose step number is the ordinal."""
    return Grid(datetime(2000, 1, 1), 1, window, horizon, chunk)


def step_metrics(
    scored: DataFrame, starts: DataFrame, grid: Grid, by: list[str], threshold: float = 0.5
) -> DataFrame:
    """Row metrics, scorable and detected starts, lead steps and false episodes per group.

    ``scored`` has ``machine, ordinal, target, probability`` and the columns of ``by``; ``starts``
    has ``machine, ordinal``. Grouping without the machine pools all machines: row metrics come
    from the rows, counts are sums, and the mean lead is over all leads.
    """
    place = [F.lit("ordinal").alias("run_id"), F.col("machine").alias("service_id")]
    at = grid.time(F.col("ordinal"))
    rows = scored.select(*place, *dict.fromkeys(["machine", *by]), at.alias("timestamp"), "target", "probability")
    onsets = starts.select(
        *place,
        F.concat_ws("-", "machine", F.col("ordinal").cast("string")).alias("incident_id"),
        F.lit("start").alias("incident_type"),
        at.alias("incident_start"),
    )
    figures = operational_summary(rows, onsets, grid, by, threshold)
    machines = rows.select(*dict.fromkeys([*by, "machine"])).distinct()
    machines = machines.groupBy(*by).agg(F.count(F.lit(1)).alias("machines"))
    joined = row_metrics(rows, by, threshold).join(figures, by).join(machines, by)
    alerts = F.col("tp") + F.col("fp")
    return joined.select(
        *by,
        "machines",
        "rows",
        "positives",
        "prevalence",
        "average_precision",
        "roc_auc",
        "brier",
        "log_loss",
        "precision",
        "recall",
        "tp",
        "fp",
        "fn",
        "tn",
        F.col("scorable_incidents").alias("scorable_starts"),
        F.col("detected_incidents").alias("detected_starts"),
        F.col("incident_detection_rate").alias("start_detection_rate"),
        (F.col("mean_lead_minutes") * 60).alias("mean_lead_steps"),
        F.col("false_episodes").alias("false_alert_episodes"),
        F.col("episodes").alias("alert_episodes"),
        alerts.alias("alert_rows"),
        F.try_divide(alerts, F.col("rows")).alias("alert_row_fraction"),
    )
