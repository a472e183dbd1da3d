"""Operational summaries over stored telemetry and predictions, merges and audits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.ranks import exact_percentiles
from telemetry_ops.grid import METRICS, Grid, moment
from telemetry_ops.operators.describe import latest
from telemetry_ops.operators.scores import decision


def _between(column: str, start: datetime, end: datetime) -> Column:
    return (F.col(column) >= moment(start)) & (F.col(column) < moment(end))


def coverage(services: DataFrame, telemetry: DataFrame, grid: Grid, start: datetime, end: datetime):
    """Expected, observed and missing points of every service, absent ones included."""
    if end <= start:
        raise ValueError(f"Empty interval: {start} to {end}")
    expected = int((end - start).total_seconds()) // grid.step_seconds
    seen = (
        telemetry.where(_between("timestamp", start, end))
        .groupBy("service_id")
        .agg(F.count("timestamp").alias("_seen"))
    )
    observed = F.coalesce("_seen", F.lit(0))
    return services.select("service_id").join(seen, "service_id", "left").select(
        "service_id",
        F.lit(expected).cast("bigint").alias("expected_points"),
        observed.alias("observed_points"),
        (F.lit(expected) - observed).alias("missing_points"),
    )


def _risk(predictions: DataFrame, by: list[str], extra: list[Column]) -> DataFrame:
    figures = predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("predictions"),
        *extra,
        F.avg("probability").alias("mean_probability"),
        F.min("probability").alias("min_probability"),
        F.max("probability").alias("max_probability"),
    )
    medians = exact_percentiles(predictions, by, "probability", [0.5]).select(
        *by, F.col("percentiles")[0].alias("median_probability")
    )
    return figures.join(medians, by)


def risk_summary(predictions: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Count, mean, extremes and median per service and model over ``[start, end)``."""
    if end <= start:
        raise ValueError(f"Empty interval: {start} to {end}")
    return _risk(predictions.where(_between("timestamp", start, end)), ["service_id", "model_id"], [])


def latest_risk(predictions: DataFrame, models: DataFrame) -> DataFrame:
    """Newest prediction of each service; ties by production time, then id."""
    newest = latest(
        predictions, ["service_id"], [F.desc("timestamp"), F.desc("produced_at"), F.asc("id")]
    )
    return newest.join(models, "model_id").select(
        *predictions.columns,
        "model_name",
        "threshold",
        (F.col("probability") >= F.col("threshold")).alias("elevated"),
    )


def daily_risk(predictions: DataFrame, models: DataFrame) -> DataFrame:
    """Figures per service, UTC day and model, with the number of elevated predictions."""
    rows = predictions.join(models.select("model_id", "threshold"), "model_id").withColumn(
        "day", F.col("timestamp").cast("date")
    )
    elevated = F.count_if(F.col("probability") >= F.col("threshold")).alias("elevated_predictions")
    return _risk(rows, ["service_id", "day", "model_id"], [elevated])


def prediction_join(predictions: DataFrame, models: DataFrame, grid: Grid) -> DataFrame:
    """Predictions with their model, decision and window bounds (derived, not stored)."""
    window = F.timestamp_add("SECOND", F.lit(-grid.window_seconds).cast("bigint"), F.col("timestamp"))
    return (
        decision(predictions.join(models, "model_id"))
        .withColumn("window_start", window)
        .withColumn("window_end", F.col("timestamp"))
    )


def prediction_history(
    joined: DataFrame,
    service_id: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int = 100,
) -> DataFrame:
    """Newest first, with optional filters; ordering and limit become one top-k per task."""
    rows = joined
    if service_id is not None:
        rows = rows.where(F.col("service_id") == service_id)
    if start is not None:
        rows = rows.where(F.col("timestamp") >= moment(start))
    if end is not None:
        rows = rows.where(F.col("timestamp") < moment(end))
    return rows.orderBy(F.desc("timestamp"), F.asc("id")).limit(limit)


# -- merges ---------------------------------------------------------------------------------------


def ingest_merge(batch: DataFrame, stored: DataFrame, now: datetime | Column) -> DataFrame:
    """First write wins: the batch with ``status`` inserted, unchanged, conflict, future or
    duplicate (a key that the batch holds more than once)."""
    keys = ["service_id", "timestamp"]
    now = moment(now)
    repeated = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    old = stored.select(*keys, F.lit(True).alias("_stored"), *[F.col(m).alias(f"_old_{m}") for m in METRICS])
    differs = F.lit(False)
    for m in METRICS:
        differs = differs | ~F.col(m).eqNullSafe(F.col(f"_old_{m}"))
    known = F.coalesce("_stored", F.lit(False))
    status = (
        F.when(F.col("_copies") > 1, "duplicate")
        .when(F.col("timestamp") > now, "future")
        .when(known & differs, "conflict")
        .when(known, "unchanged")
        .otherwise("inserted")
    )
    joined = batch.join(repeated, keys).join(old, keys, "left")
    return joined.select(*batch.columns, status.alias("status"))


def append_ingest(merged: DataFrame, path: str, ingested_at: datetime | Column) -> dict[str, int]:
    """Append the inserted rows, or fail as a whole if any row may not be written."""
    counts = {r["status"]: r["count"] for r in merged.groupBy("status").count().collect()}
    wrong = {k: v for k, v in counts.items() if k not in ("inserted", "unchanged")}
    if wrong:
        raise ValueError(f"Batch rejected: {wrong}")
    arrival = moment(ingested_at)
    (
        merged.where("status = 'inserted'")
        .drop("status")
        .withColumn("ingested_at", arrival)
        .write.mode("append")
        .parquet(path)
    )
    return {"inserted": counts.get("inserted", 0), "unchanged": counts.get("unchanged", 0)}


def unscored_requests(requests: DataFrame, stored: DataFrame, keys=("service_id", "timestamp", "model_id")):
    """Requests without a stored prediction; stored ones are permanent and never scored again."""
    return requests.join(stored.select(*keys), list(keys), "left_anti")


def score_requests(
    requests: DataFrame, stored: DataFrame, scored: DataFrame, keys=("service_id", "timestamp", "model_id")
) -> DataFrame:
    """Every distinct request with its probability, and whether it was ``created`` now.

    ``scored`` holds fresh scores (null where the history is incomplete).
    """
    keys = list(keys)
    asked = requests.select(*keys).distinct()
    old = stored.select(*keys, F.col("probability").alias("_old"), F.lit(True).alias("_stored"))
    fresh = scored.select(*keys, F.col("probability").alias("_new"))
    known = F.coalesce("_stored", F.lit(False))
    return (
        asked.join(old, keys, "left")
        .join(fresh, keys, "left")
        .select(
            *keys,
            F.when(known, F.col("_old")).otherwise(F.col("_new")).alias("probability"),
            (~known & F.col("_new").isNotNull()).alias("created"),
        )
    )


# -- audits ---------------------------------------------------------------------------------------


def parity_audit(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Compare two feature tables cell by cell: rows on one side, unequal cells, largest error."""
    a = left.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = right.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = a.join(b, keys, "full_outer")
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_a_{c}").alias("x"), F.col(f"_b_{c}").alias("y"))
            for c in columns
        ]
    )
    matched = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    differ = matched & ~F.col("x").eqNullSafe(F.col("y"))
    return (
        both.select("_a", "_b", F.inline(cells))
        .groupBy("column")
        .agg(
            F.count_if(matched).alias("matched_rows"),
            F.count_if(F.col("_b").isNull()).alias("left_only"),
            F.count_if(F.col("_a").isNull()).alias("right_only"),
            F.count_if(differ).alias("unequal"),
            F.max(F.when(matched, F.abs(F.col("x") - F.col("y")))).alias("max_error"),
        )
    )


def latency_percentiles(
    timings: DataFrame, by: list[str], value: str, status: str, statuses: list[str]
) -> DataFrame:
    """Minimum, median, 95th percentile and maximum per workload, and a count per status."""
    cuts = exact_percentiles(timings, by, value, [0.0, 0.5, 0.95, 1.0])
    counts = timings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        *[F.count_if(F.col(status) == s).alias(f"status_{s}") for s in statuses],
    )
    p = F.col("percentiles")
    return counts.join(cuts, by).select(
        *by,
        "requests",
        *[f"status_{s}" for s in statuses],
        p[0].alias("min"),
        p[1].alias("p50"),
        p[2].alias("p95"),
        p[3].alias("max"),
    )
