"""Streaming forms of ingest, features, scoring, drift, health, delayed labels and alert episodes.

Event times are zoned timestamps (watermarks need them). The first write wins, so exactness rests on the
join with the target table; the watermark bounds state. Ingest sets rows behind its watermark aside
in full and counts them, and ``merge_late`` brings them in for a batch rebuild; every job returns what
``run_available`` counted, the rows refused by stateful steps among it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetry_ops.grid import FEATURES, METRICS, SECOND, STATISTICS, Grid, floor_div, moment
from telemetry_ops.operators.drift import DriftConfig, bin_counts, stability_of_counts
from telemetry_ops.operators.features import _fixed_point
from telemetry_ops.operators.quality import parse_records
from telemetry_ops.operators.summaries import append_ingest, ingest_merge, unscored_requests
from telemetry_ops.streaming.runner import append_new, around, read_table, run_available
from telemetry_ops.streaming.state import CERTIFICATE, ONSET, PREDICTION, DelayedOutcomes, WindowPoints, chunks

STORED = T.StructType(
    [T.StructField("service_id", T.StringType()), T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(m, T.DoubleType()) for m in METRICS]
    + [T.StructField("ingested_at", T.TimestampNTZType())]
)
LATE = T.StructType([f for f in STORED if f.name != "ingested_at"] + [T.StructField("copies", T.LongType())])
COUNTS = "inserted long, unchanged long, rejected long, late long, latest timestamp_ntz, batch long"


def ingest_stream(
    records: DataFrame,
    body: str,
    target: str,
    rejects: str,
    checkpoint: str,
    *,
    services: DataFrame | None,
    now: Column,
    late: str | None = None,
    delay: str | None = None,
    counts: str | None = None,
    state_partitions: int | None = None,
) -> dict[str, int]:
    """Parse JSON records, reject invalid, future and conflicting ones, and store first writes.

    Equal copies inside a batch count once; differing copies are rejected. ``rejects`` gets one
    folder per batch, overwritten on replay, with the reason of every refused record.

    With ``delay`` the watermark is the newest time stored by earlier batches less the delay. Valid rows behind
    it go to the table ``late``, whole, instead of the target, so that streams over the target never meet a row
    they would have to drop. ``counts`` gets one row per batch, made before the batch is stored and kept on
    replay; ``inserted + unchanged + rejected + late`` is the number of records, a second equal copy of a
    stored row being unchanged.
    """
    if delay is not None and (late is None or counts is None):
        raise ValueError("A delay needs a table for late rows and one for counts")

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parsed = parse_records(batch, body, services).persist()
        try:
            valid = parsed.where("reason IS NULL").groupBy("service_id", "timestamp", *METRICS).agg(F.count(F.lit(1)).alias("copies"))
            mark = None
            if delay is not None:
                done = ingest_counts(spark, counts).where(F.col("batch") < number)
                mark = done.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("mark")).first()["mark"]
            behind = F.lit(False) if mark is None else F.col("timestamp") < moment(mark)
            if late is not None:
                valid.where(behind).select(*[f.name for f in LATE]).write.mode("overwrite").parquet(f"{late}/batch={number}")
            timely = valid.where(~behind)
            stored = around(read_table(spark, target, STORED), timely, "timestamp")
            merged = ingest_merge(timely, stored, now).persist()
            try:
                refused = merged.where("status NOT IN ('inserted', 'unchanged')").select(
                    "service_id", "timestamp", F.col("status").alias("reason")
                )
                bad = parsed.where("reason IS NOT NULL").select("service_id", "timestamp", "reason")
                bad.unionByName(refused).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
                if counts is not None and ingest_counts(spark, counts).where(F.col("batch") == number).isEmpty():
                    n_late = valid.where(behind).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
                    _counted(merged).select(
                        "inserted", "unchanged", (F.col("refused") + bad.count()).alias("rejected"), F.lit(n_late).cast("long").alias("late"), "latest"
                    ).write.mode("overwrite").parquet(f"{counts}/batch={number}")
                (
                    merged.where("status = 'inserted'")
                    .select("service_id", "timestamp", *METRICS, now.alias("ingested_at"))
                    .write.mode("append")
                    .parquet(target)
                )
            finally:
                merged.unpersist()
        finally:
            parsed.unpersist()

    return run_available(records, handle, checkpoint, "append", state_partitions)


def _counted(merged: DataFrame) -> DataFrame:
    fresh, known = F.col("status") == "inserted", F.col("status").isin("inserted", "unchanged")

    def total(condition, n):
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    return merged.agg(
        F.count_if(fresh).alias("inserted"),
        (total(known, F.col("copies")) - F.count_if(fresh)).alias("unchanged"),
        total(~known, F.col("copies")).alias("refused"),
        F.max(F.when(known, F.col("timestamp"))).alias("latest"),
    )


def ingest_counts(spark: SparkSession, path: str) -> DataFrame:
    """What ``ingest_stream`` counted, one row per batch."""
    return read_table(spark, path, spark.createDataFrame([], COUNTS).schema)


def merge_late(spark: SparkSession, target: str, late: str, now: Column) -> dict[str, int]:
    """Brings rows that ingest had set aside into the target, first write first; done again, it adds nothing.

    Rows that contradict a stored or another late row stay out and are counted as ``conflict`` or ``duplicate``.
    """
    rows = read_table(spark, late, LATE).select("service_id", "timestamp", *METRICS).distinct().persist()
    try:
        merged = ingest_merge(rows, around(read_table(spark, target, STORED), rows, "timestamp"), now).persist()
        try:
            found = {r["status"]: r["count"] for r in merged.groupBy("status").count().collect()}
            append_ingest(merged.where("status IN ('inserted', 'unchanged')"), target, now)
        finally:
            merged.unpersist()
    finally:
        rows.unpersist()
    return found


def sliding_features(
    telemetry: DataFrame,
    grid: Grid,
    *,
    delay: str,
    coverage_start: Column,
    scales: dict[str, int] | None = None,
    metrics: tuple[str, ...] = METRICS,
    chunk_points: int | None = None,
) -> DataFrame:
    """Window features by a stateful processor, each complete window once; use append mode.

    A point is kept once, in the state of its (service, chunk), and once more where the next chunk's windows
    reach back to it; chunks are four windows long unless told otherwise. A late row can still complete windows
    until the watermark passes; a timer then drops the chunk. Windows start at the grid's phase; rows off
    the grid are left out, and a null metric or a repeated key makes its windows incomplete. A repeat that
    comes after its window does not take the window back. ``timestamp`` stays an event time, so that stateful
    steps may follow.
    """
    scales = scales or {}
    points = grid.window_points
    length = chunk_points or 4 * points
    us = F.unix_micros("timestamp") - grid.phase_us
    whole = F.lit(True)
    for metric in metrics:
        whole = whole & F.col(metric).isNotNull()
    rows = telemetry.withWatermark("timestamp", delay).where(F.pmod(us, F.lit(grid.step_us)) == 0)
    # A processor sees names without a leading underscore only.
    rows = rows.select("service_id", "timestamp", floor_div(us, grid.step_us).alias("step"), whole.alias("whole"), *_fixed_point(scales, metrics))
    rows = rows.select(
        "service_id", "timestamp", "step", "whole", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in metrics],
        chunks(F.col("step"), F.col("step") + points - 1, length).alias("chunk"),
    )
    # One array per window: a frame costs the worker time for each of its columns, and there is one per chunk.
    built = rows.groupBy("service_id", "chunk").transformWithStateInPandas(
        WindowPoints(points, length, grid.step_us, grid.phase_us, tuple(metrics), scales),
        "service_id string, timestamp timestamp, figures array<double>", "append", "eventTime", eventTimeColumnName="timestamp",
    )
    names = [f"{m}__{s}" for m in metrics for s in STATISTICS]
    built = built.select("service_id", "timestamp", *[F.get("figures", F.lit(i)).alias(name) for i, name in enumerate(names)])
    first = F.timestamp_add("SECOND", F.lit(grid.window_seconds).cast("bigint"), coverage_start)
    return built.where(F.col("timestamp") >= first)


def _zone_free(batch: DataFrame) -> DataFrame:
    return batch.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def feature_table(features: DataFrame, path: str, checkpoint: str, state_partitions: int | None = None) -> dict[str, int]:
    """Store each complete window once."""
    return run_available(
        features,
        lambda batch, _: append_new(_zone_free(batch), path, ["service_id", "timestamp"], "timestamp"),
        checkpoint,
        "append",
        state_partitions,
    )


def score_stream(
    features: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    model_id: str,
    path: str,
    checkpoint: str,
    *,
    now: Column,
    state_partitions: int | None = None,
) -> dict[str, int]:
    """Score complete windows; the first result of a (service, time, model) is permanent."""
    keys = ["service_id", "timestamp", "model_id"]

    def handle(batch: DataFrame, _: int) -> None:
        # Read twice, for its bounds and for the scores; the state behind it must not be advanced twice.
        rows = _zone_free(batch).withColumn("model_id", F.lit(model_id)).dropDuplicates(keys).persist()
        schema = T.StructType(
            [f for f in rows.schema if f.name in keys]
            + [T.StructField("probability", T.DoubleType()), T.StructField("produced_at", T.TimestampNTZType())]
        )
        try:
            stored = around(read_table(batch.sparkSession, path, schema), rows, "timestamp")
            fresh = unscored_requests(rows, stored, tuple(keys))
            scored = score(fresh).select(
                *[f.name for f in schema if f.name in keys], "probability", now.alias("produced_at")
            )
            scored.write.mode("append").parquet(path)
        finally:
            rows.unpersist()

    return run_available(features, handle, checkpoint, "append", state_partitions)


def scored_features(features: DataFrame, score: Callable[[DataFrame], Column], columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """``timestamp, feature, value`` of all features and of the score, as the drift of a stream reads them."""
    return features.select("timestamp", *columns, score(features).alias("probability")).unpivot(["timestamp"], [*columns, "probability"], "feature", "value")


def drift_stream(
    long: DataFrame,
    reference: DataFrame,
    config: DriftConfig,
    interval: str,
    path: str,
    checkpoint: str,
    *,
    delay: str | None = None,
    state_partitions: int | None = None,
) -> dict[str, int]:
    """PSI and status per tumbling interval, stored when the watermark closes the interval.

    ``long`` has ``timestamp, feature, value``. The state is one counter per interval, feature and
    bin. Without a ``delay`` the watermark is that of an earlier stateful step, such as ``sliding_features``.
    """
    timed = (long if delay is None else long.withWatermark("timestamp", delay)).withColumn("interval", F.window("timestamp", interval))
    most = reference.agg(F.max(F.size("edges"))).first()[0] or 0
    counts = bin_counts(timed, reference, ("interval",), most)

    def handle(batch: DataFrame, _: int) -> None:
        found = stability_of_counts(batch, reference, config, ("interval",))
        append_new(
            found.select(
                F.col("interval.start").cast("timestamp_ntz").alias("start"),
                F.col("interval.end").cast("timestamp_ntz").alias("end"),
                "feature",
                "status",
                "samples",
                "psi",
            ),
            path,
            ["start", "feature"],
            "start",
        )

    return run_available(counts, handle, checkpoint, "append", state_partitions)


def health_stream(
    telemetry: DataFrame,
    services: DataFrame,
    grid: Grid,
    interval: timedelta,
    path: str,
    checkpoint: str,
    *,
    delay: str,
    state_partitions: int | None = None,
) -> dict[str, int]:
    """Service health per tumbling interval, stored when the watermark closes the interval.

    The state is one counter per interval, service and lag, from which the median is exact. Services without
    rows in a closed interval are listed with none; an interval without any row is not known to the stream.
    """
    lag = (F.unix_micros("ingested_at") - F.unix_micros("timestamp")) / float(SECOND)
    window = F.window("timestamp", f"{int(interval.total_seconds())} seconds")
    timed = telemetry.withWatermark("timestamp", delay).select("service_id", "timestamp", window.alias("interval"), lag.alias("lag"))
    counts = timed.groupBy("interval", "service_id", "lag").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("latest"))
    expected = interval // timedelta(seconds=grid.step_seconds)

    def handle(batch: DataFrame, _: int) -> None:
        found = batch.groupBy("interval", "service_id").agg(
            F.sum("n").alias("_rows"), F.max("latest").alias("_latest"), F.min("lag").alias("lag_min_seconds"),
            F.expr("percentile(lag, 0.5, n)").alias("lag_median_seconds"), F.max("lag").alias("lag_max_seconds"),
        ).persist()
        try:
            # Intervals that close in a batch are as many as its time range holds.
            closed = [r["interval"] for r in found.select("interval").distinct().collect()]
            if not closed:
                return
            known = F.explode(F.array(*[F.struct(F.lit(i["start"]).alias("start"), F.lit(i["end"]).alias("end")) for i in closed]))
            listed = services.select("service_id", known.alias("interval"))
            rows = F.coalesce("_rows", F.lit(0))
            health = listed.join(found, ["interval", "service_id"], "left").select(
                F.col("interval.start").cast("timestamp_ntz").alias("start"),
                F.col("interval.end").cast("timestamp_ntz").alias("end"),
                "service_id",
                rows.alias("rows"),
                F.lit(expected).cast("bigint").alias("expected_points"),
                (F.lit(expected) - rows).alias("missing_points"),
                (rows / F.lit(float(expected))).alias("grid_completeness"),
                ((F.unix_micros("interval.end") - F.unix_micros("_latest")) / float(SECOND)).alias("event_freshness_seconds"),
                "lag_min_seconds",
                "lag_median_seconds",
                "lag_max_seconds",
            )
            append_new(health, path, ["start", "service_id"], "start")
        finally:
            found.unpersist()

    return run_available(counts, handle, checkpoint, "append", state_partitions)


def delayed_stream(
    predictions: DataFrame,
    onsets: DataFrame,
    certificates: DataFrame,
    grid: Grid,
    path: str,
    checkpoint: str,
    *,
    delay: str,
    patience: timedelta,
    cutoff: datetime | None = None,
    state_partitions: int | None = None,
) -> dict[str, int]:
    """Predictions wait until certificates cover their horizon ``(t, t+H]`` and are then labelled, once.

    Event times are those at which records became known: ``produced_at`` of predictions, ``recorded_at`` of onsets
    and certificates. A covered prediction leaves when the watermark passes the certificate's record, which
    vouches for the onsets inside it, with target 1 or 0. After ``patience`` beyond its chunk and horizon it leaves
    as ``uncertified``. With a ``cutoff`` the result is that of the batch form at the cutoff: what is known later
    is ignored, and ``immature`` and ``unavailable_prediction`` are told as well. State is kept per service and
    chunk of the grid, in which certificates are repeated as far as they reach.
    """
    chunk, horizon = grid.chunk_us, grid.horizon_us

    def known(rows: DataFrame, kind: int, time: str, at: str, *, low: Column, high: Column, **more: Column) -> DataFrame:
        return rows.withWatermark(time, delay).select(
            "service_id", F.col(time).alias("known_at"), F.unix_micros(time).alias("known"), F.lit(kind).alias("kind"),
            more.get("id", F.lit(None).cast("string")).alias("id"), F.unix_micros(at).alias("at"),
            more.get("until", F.lit(0).cast("long")).alias("until"), more.get("probability", F.lit(0.0)).alias("probability"),
            chunks(low, high, chunk).alias("chunk"),
        )

    at, start, end = (F.unix_micros(c) for c in ("timestamp", "start", "end"))
    rows = (
        known(predictions, PREDICTION, "produced_at", "timestamp", low=at, high=at, id=F.col("id"), probability=F.col("probability"))
        .unionByName(known(onsets, ONSET, "recorded_at", "start", low=start - horizon, high=start))
        .unionByName(known(certificates, CERTIFICATE, "recorded_at", "start", low=start - horizon, high=end, until=end))
    )
    epoch = datetime(1970, 1, 1)
    micros = timedelta(microseconds=1)
    labelled = rows.groupBy("service_id", "chunk").transformWithStateInPandas(
        DelayedOutcomes(horizon, chunk, patience // micros, None if cutoff is None else (cutoff - epoch) // micros),
        "id string, service_id string, timestamp timestamp, probability double, reason string, target long",
        "append",
        "eventTime",
    )
    return run_available(
        labelled, lambda batch, _: append_new(_zone_free(batch), path, ["id"], "timestamp"), checkpoint, "append", state_partitions
    )


def episode_stream(
    scores: DataFrame,
    grid: Grid,
    threshold: float,
    keys: list[str],
    path: str,
    checkpoint: str,
    *,
    delay: str,
    state_partitions: int | None = None,
) -> dict[str, int]:
    """Runs of consecutive alerted steps as session windows; stored when the watermark closes them.

    The gap is one step and a microsecond, so that neighbouring steps join and a missing one splits.
    """
    alerts = scores.where(F.col("probability") >= threshold).withWatermark("timestamp", delay)
    gap = f"{grid.step_seconds} seconds 1 microsecond"
    sessions = alerts.groupBy(*keys, F.session_window("timestamp", gap).alias("_session")).agg(
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("alert_points")
    )
    closed = sessions.select(
        *keys,
        F.col("start").cast("timestamp_ntz").alias("start"),
        F.col("end").cast("timestamp_ntz").alias("end"),
        "alert_points",
    )
    return run_available(
        closed, lambda batch, _: append_new(batch, path, [*keys, "start"], "start"), checkpoint, "append", state_partitions
    )
