"""Certified outcome coverage, delayed labels and the import of outcome records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.timeline import running
from telemetry_ops.grid import Grid, floor_div, moment
from telemetry_ops.operators.episodes import operational_summary
from telemetry_ops.operators.labels import starts_ahead
from telemetry_ops.operators.scores import row_metrics

SERVICE = ["service_id"]


def merge_coverage(coverage: DataFrame, grid: Grid, cutoff: datetime | Column | None = None) -> DataFrame:
    """Union of the ``(start, end]`` certificates known by the cutoff, as disjoint intervals.

    Touching certificates join. A certificate opens a new interval when it starts after every
    earlier end; running maxima go through time buckets, so one service may own most certificates.
    """
    known = coverage if cutoff is None else coverage.where(F.col("recorded_at") <= moment(cutoff))
    rows = known.select(
        "service_id", grid.us("start").alias("_from"), grid.us("end").alias("_to"), "source_id"
    ).withColumn("_bucket", floor_div(F.col("_from"), grid.chunk_us))
    order = ["_from", "_to", "source_id"]
    seen = running(rows, SERVICE, order, "_bucket", {"_reach": ("max", F.col("_to"))}, False)
    opened = seen.withColumn(
        "_new", F.coalesce((F.col("_from") > F.col("_reach")).cast("bigint"), F.lit(1))
    ).drop("_reach")
    islands = running(opened, SERVICE, order, "_bucket", {"_island": ("sum", F.col("_new"))})
    merged = islands.groupBy("service_id", "_island").agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to")
    )

    def time(us):
        return F.timestamp_add("MICROSECOND", us, grid.time(F.lit(0)))

    return merged.select("service_id", time(F.col("_from")).alias("start"), time(F.col("_to")).alias("end"))


def covered_horizons(points: DataFrame, merged: DataFrame, grid: Grid) -> DataFrame:
    """Adds ``covered``: does one merged interval contain ``(t, t+H]``?

    Merged intervals are disjoint, so only the latest one that starts at or before t can. It is
    carried along the timeline instead of being joined over a range.
    """
    events = points.withColumn("_at", grid.us("timestamp")).withColumn("_kind", F.lit(1)).unionByName(
        merged.select(
            "service_id",
            grid.us("start").alias("_at"),
            F.lit(0).alias("_kind"),
            grid.us("end").alias("_reach"),
        ),
        allowMissingColumns=True,
    )
    events = events.withColumn("_bucket", floor_div(F.col("_at"), grid.chunk_us))
    latest = F.when(F.col("_kind") == 0, F.struct(F.col("_at").alias("from"), F.col("_reach").alias("to")))
    carried = running(events, SERVICE, ["_at", "_kind"], "_bucket", {"_last": ("max", latest)})
    reach = F.col("_last.to") >= F.col("_at") + grid.horizon_us
    return (
        carried.where("_kind = 1")
        .withColumn("covered", F.coalesce(reach, F.lit(False)))
        .drop("_at", "_kind", "_reach", "_bucket", "_last")
    )


def delayed_labels(
    predictions: DataFrame,
    incident_starts: DataFrame,
    coverage: DataFrame,
    grid: Grid,
    cutoff: datetime | Column,
) -> DataFrame:
    """Adds ``reason`` (first matching exclusion, null if eligible) and ``target``.

    Exclusions in order: ``unavailable_prediction`` (produced after the cutoff), ``immature``
    (``t+H`` after the cutoff), ``uncertified`` (horizon not covered by known certificates).
    """
    cutoff = moment(cutoff)
    onsets = incident_starts.where(F.col("recorded_at") <= cutoff).select("service_id", "start")
    rows = covered_horizons(predictions, merge_coverage(coverage, grid, cutoff), grid)
    rows = starts_ahead(rows, onsets, grid)
    horizon_end = grid.us("timestamp") + grid.horizon_us
    reason = (
        F.when(F.col("produced_at") > cutoff, "unavailable_prediction")
        .when(horizon_end > grid.us(cutoff), "immature")
        .when(~F.col("covered"), "uncertified")
    )
    labelled = rows.withColumn("reason", reason)
    target = F.when(F.col("reason").isNull(), F.col("starts_ahead").cast("bigint"))
    return labelled.withColumn("target", target).drop("covered", "starts_ahead")


def delayed_exclusions(labelled: DataFrame) -> DataFrame:
    """Rows per exclusion, with all three listed."""
    reason = F.col("reason")
    names = ("unavailable_prediction", "immature", "uncertified")
    counts = labelled.agg(*[F.count_if(reason.eqNullSafe(n)).alias(n) for n in names])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("rows")) for n in names]))
    )


def delayed_metrics(
    labelled: DataFrame,
    incident_starts: DataFrame,
    services: DataFrame,
    grid: Grid,
    cutoff: datetime | Column,
    threshold: float,
) -> DataFrame:
    """Row and operational figures of the eligible rows, overall and per service.

    ``scope`` is ``all`` or a service. Services without eligible rows are listed as
    ``insufficient``.
    """
    # The one run is named by a column: a literal would be folded away, and joins on it would lose their key.
    one_run = F.concat(F.lit("operational"), F.substring("service_id", 1, 0)).alias("run_id")
    rows = labelled.where(F.col("reason").isNull()).select(
        one_run, "service_id", "timestamp", "probability", "target"
    )
    truth = incident_starts.where(F.col("recorded_at") <= moment(cutoff)).select(
        one_run,
        "service_id",
        F.col("source_id").alias("incident_id"),
        F.lit("confirmed").alias("incident_type"),
        F.col("start").alias("incident_start"),
    )
    parts = []
    for by in (["run_id"], ["service_id"]):
        figures = row_metrics(rows, by, threshold).join(
            operational_summary(rows, truth, grid, by, threshold), by
        )
        scope = F.lit("all") if by == ["run_id"] else F.col("service_id")
        parts.append(figures.withColumn("scope", scope).drop(*by))
    figures = parts[0].unionByName(parts[1])
    scopes = services.select(F.col("service_id").alias("scope")).unionByName(
        services.sparkSession.range(1).select(F.lit("all").alias("scope"))
    )
    minutes = grid.step_seconds / 60.0
    return scopes.join(figures, "scope", "left").select(
        "*",
        F.try_divide(F.col("alert_minutes") / minutes, F.col("rows")).alias("alert_row_fraction"),
        F.when(F.coalesce("rows", F.lit(0)) > 0, "evaluated").otherwise("insufficient").alias("status"),
    )


def import_outcomes(
    incidents: DataFrame,
    coverage: DataFrame,
    stored_incidents: DataFrame,
    stored_coverage: DataFrame,
    grid: Grid,
    now: datetime | Column,
) -> tuple[DataFrame, DataFrame]:
    """Classify both record sets, incidents first: each distinct record with ``status, records``.

    ``future``, ``conflict`` (same source, other values) and ``contradiction`` (a new incident
    inside a stored certificate) are errors; ``new`` and ``unchanged`` are not. Equal records in
    one batch count once as new. Callers append only when ``import_errors`` is empty.
    """
    now = moment(now)
    new_incidents = _classify(incidents, stored_incidents, ["service_id", "start"], now)
    marked = _inside_certificate(new_incidents, stored_coverage, grid)
    status = F.when((F.col("status") == "new") & F.col("_certified"), "contradiction").otherwise(
        F.col("status")
    )
    return (
        marked.withColumn("status", status).drop("_certified"),
        _classify(coverage, stored_coverage, ["service_id", "start", "end"], now),
    )


def _classify(batch: DataFrame, stored: DataFrame, values: list[str], now: Column) -> DataFrame:
    distinct = batch.groupBy("source_id", *values).agg(F.count(F.lit(1)).alias("records"))
    clashes = distinct.groupBy("source_id").agg(F.count(F.lit(1)).alias("_versions"))
    old = stored.select(
        "source_id", F.lit(True).alias("_stored"), *[F.col(v).alias(f"_old_{v}") for v in values]
    )
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.col(f"_old_{v}"))
    status = (
        F.when(F.greatest(*[F.col(v) for v in values if v != "service_id"], F.col("start")) > now, "future")
        .when(F.coalesce("_stored", F.lit(False)) & differs, "conflict")
        .when(F.col("_versions") > 1, "conflict")
        .when(F.coalesce("_stored", F.lit(False)), "unchanged")
        .otherwise("new")
    )
    return (
        distinct.join(clashes, "source_id")
        .join(old, "source_id", "left")
        .select("source_id", *values, "records", status.alias("status"))
    )


def _inside_certificate(incidents: DataFrame, certificates: DataFrame, grid: Grid) -> DataFrame:
    """Adds ``_certified``: ``cert.start < onset <= cert.end`` for some certificate.

    It holds exactly when the largest end among the certificates that start before the onset
    reaches it, which a running maximum gives.
    """
    events = incidents.withColumn("_at", grid.us("start")).withColumn("_kind", F.lit(0)).unionByName(
        certificates.select(
            "service_id",
            grid.us("start").alias("_at"),
            F.lit(1).alias("_kind"),
            grid.us("end").alias("_to"),
        ),
        allowMissingColumns=True,
    )
    events = events.withColumn("_bucket", floor_div(F.col("_at"), grid.chunk_us))
    carried = running(
        events, SERVICE, ["_at", "_kind"], "_bucket", {"_reach": ("max", F.col("_to"))}, False
    )
    return (
        carried.where("_kind = 0")
        .withColumn("_certified", F.coalesce(F.col("_reach") >= F.col("_at"), F.lit(False)))
        .drop("_at", "_kind", "_to", "_bucket", "_reach")
    )


def import_counts(classified: DataFrame) -> DataFrame:
    """Records per status; repeats of a new record count as unchanged."""
    fresh = F.col("status") == "new"
    return (
        classified.select(
            F.inline(
                F.array(
                    F.struct(
                        F.when(fresh, "inserted").otherwise(F.col("status")).alias("status"),
                        F.when(fresh, F.lit(1)).otherwise(F.col("records")).cast("bigint").alias("n"),
                    ),
                    F.struct(
                        F.lit("unchanged").alias("status"),
                        F.when(fresh, F.col("records") - 1).otherwise(F.lit(0)).cast("bigint").alias("n"),
                    ),
                )
            )
        )
        .groupBy("status")
        .agg(F.sum("n").alias("records"))
        .where("records > 0")
    )


def import_errors(classified: DataFrame) -> DataFrame:
    return classified.where(~F.col("status").isin("new", "unchanged"))


def append_outcomes(classified: DataFrame, path: str, recorded_at: datetime | Column) -> None:
    """Append the new records; the whole import fails if any record is an error."""
    wrong = import_errors(classified).groupBy("status").count().collect()
    if wrong:
        raise ValueError(f"Import rejected: {sorted((r['status'], r['count']) for r in wrong)}")
    fresh = classified.where("status = 'new'").drop("records", "status")
    fresh.withColumn("recorded_at", moment(recorded_at)).write.mode("append").parquet(path)
