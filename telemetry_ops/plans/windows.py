"""Queries: labels, features, partitions and the ordinal study."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetry_ops.grid import FEATURES, METRICS, TARGET
from telemetry_ops.operators import features, labels, partitions
from telemetry_ops.operators.describe import relative_minutes
from telemetry_ops.operators.quality import key_grid
from telemetry_ops.plans.registry import query
from telemetry_ops.plans.tables import SCALES, STAGES

_FEATURES = ", ".join(FEATURES)


@query(
    "history_complete",
    """SELECT s.service_id, TIMESTAMP '2024-01-01' + to_hours(h) AS timestamp,
         h >= 15 AND (SELECT count(*) FROM telemetry AS t WHERE t.service_id = s.service_id
                      AND t.step BETWEEN h - 14 AND h) = 15 AS history_complete
       FROM services AS s CROSS JOIN range(720) AS x(h)""",
)
def history_complete(t):
    """For every key of the grid, also those that telemetry lacks."""
    return labels.history_complete(t.telemetry, key_grid(t.services, t.grid, 0, 720), t.grid)


@query("future_labels", "SELECT * FROM labelled")
def future_labels(t):
    return t.labels


@query("window_features", "SELECT * FROM features")
def window_features(t):
    return t.features


@query(
    "pit_features",
    f"""WITH seen AS (SELECT r.service_id, r.timestamp, r.cutoff, count(t.step) AS n
          FROM (SELECT service_id, timestamp, step, ingested_at + INTERVAL 20 MINUTE AS cutoff
                FROM telemetry) AS r
          LEFT JOIN telemetry AS t ON t.service_id = r.service_id
            AND t.step BETWEEN r.step - 14 AND r.step AND t.ingested_at <= r.cutoff
          GROUP BY ALL)
        SELECT s.service_id, s.timestamp, s.cutoff, 15 - n AS missing_points,
          {", ".join(f"CASE WHEN n = 15 THEN {f} END AS {f}" for f in FEATURES)}
        FROM seen AS s LEFT JOIN features_any_start AS f USING (service_id, timestamp)""",
)
def pit_features(t):
    """One request per telemetry key, scored twenty minutes after its row arrived."""
    requests = t.rollup.select(
        "service_id",
        "timestamp",
        F.timestamp_add("MINUTE", F.lit(20).cast("bigint"), F.col("ingested_at")).alias("cutoff"),
    )
    return features.point_in_time_features(
        requests, t.rollup, t.grid, request_key=["service_id", "timestamp", "cutoff"], scales=SCALES
    )


@query(
    "attach_targets",
    f"""SELECT service_id, timestamp, {_FEATURES}, incident_within_horizon
        FROM features JOIN labelled USING (service_id, timestamp)
        WHERE history_complete AND horizon_complete AND incident_within_horizon IS NOT NULL""",
)
def attach_targets(t):
    return features.attach_targets(t.features, t.labels)


@query(
    "assign_partitions",
    "SELECT run_id, service_id, timestamp, incident_within_horizon, partition FROM modelling_rows",
)
def assign_partitions(t):
    return t.rule_rows.select("run_id", "service_id", "timestamp", TARGET, "partition")


@query(
    "onset_partition",
    """SELECT run_id, incident_id, service_id, incident_start, r."group",
         CASE WHEN r."group" <> 'development' THEN r."group"
              WHEN h < 96 THEN 'train' WHEN h < 144 THEN 'calibration'
              WHEN h < 192 THEN 'validation' ELSE 'temporal_test' END AS onset_partition
       FROM (SELECT *, date_diff('hour', TIMESTAMP '2024-01-01', incident_start) % 240 AS h
             FROM run_incidents) JOIN runs AS r USING (run_id)""",
)
def onset_partition(t):
    return partitions.onset_partition(t.run_incidents, t.runs, t.grid, STAGES).select(
        "run_id", "incident_id", "service_id", "incident_start", "group", "onset_partition"
    )


_ORDINAL = f"""SELECT service_id AS machine, ordinal, label, {", ".join(METRICS)} FROM (
  SELECT t.*, row_number() OVER (PARTITION BY service_id ORDER BY step) - 1 AS ordinal,
    CAST(latency_p95_ms > 60 AS BIGINT) AS label FROM telemetry AS t)"""


def ordinal_rows(t):
    """Telemetry as ordinal rows per machine with a 0/1 label; gaps close up."""
    from telemetry_ops.functions.timeline import running

    chunked = t.telemetry.withColumn(
        "_piece", F.call_function("div", F.col("step"), F.lit(t.grid.chunk_points))
    )
    rows = running(
        chunked, ["service_id"], ["step"], "_piece", {"ordinal": ("sum", F.lit(1).cast("bigint"))}, False
    )
    return rows.select(
        F.col("service_id").alias("machine"),
        "ordinal",
        (F.col("latency_p95_ms") > 60).cast("bigint").alias("label"),
        *METRICS,
    )


@query(
    "run_starts",
    f"""SELECT machine, ordinal FROM (SELECT *, coalesce(lag(label) OVER
          (PARTITION BY machine ORDER BY ordinal), 0) AS prev FROM ({_ORDINAL}))
        WHERE label = 1 AND prev = 0""",
)
def run_starts(t):
    found = labels.run_starts(ordinal_rows(t), "machine", "ordinal", "label", t.grid.chunk_points)
    return found.select("machine", "ordinal")


_STARTS = f"""SELECT machine, ordinal, label, latency_p95_ms, error_rate,
    CAST(label = 1 AND coalesce(lag(label) OVER (PARTITION BY machine ORDER BY ordinal), 0) = 0
         AS BIGINT) AS start, count(*) OVER (PARTITION BY machine) AS n FROM ({_ORDINAL})"""


@query(
    "ordinal_targets",
    f"""SELECT machine, ordinal, CASE WHEN ordinal + 10 < n THEN coalesce(max(start) OVER
          (PARTITION BY machine ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), 0)
          END AS y FROM ({_STARTS})""",
)
def ordinal_targets(t):
    found = labels.ordinal_targets(
        ordinal_rows(t), "machine", "ordinal", "label", 10, t.grid.chunk_points
    )
    return found.select("machine", "ordinal", "y")


@query(
    "rolling_mean",
    f"""SELECT machine, ordinal, {", ".join(METRICS)}, {", ".join(
          f"CASE WHEN count(*) OVER w = 15 THEN round(avg({m}) OVER w, 6) END AS {m}__mean" for m in METRICS)}
        FROM ({_ORDINAL})
        WINDOW w AS (PARTITION BY machine ORDER BY ordinal ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""",
)
def rolling_mean(t):
    values = list(METRICS)
    found = partitions.rolling_mean(
        ordinal_rows(t), "machine", "ordinal", values, 15, t.grid.chunk_points
    )
    return found.select(
        "machine", "ordinal", *values, *[F.round(f"{v}__mean", 6).alias(f"{v}__mean") for v in values]
    )


@query(
    "ordinal_partitions",
    f"""SELECT machine, ordinal, CASE
          WHEN ordinal - 15 >= 0 AND ordinal + 10 < floor(n * 0.5::DOUBLE) THEN 'train'
          WHEN ordinal - 15 >= floor(n * 0.5::DOUBLE) AND ordinal + 10 < floor(n * 0.7::DOUBLE) THEN 'validation'
          WHEN ordinal - 15 >= floor(n * 0.7::DOUBLE) AND ordinal + 10 < n THEN 'evaluation'
          ELSE 'purged' END AS partition FROM ({_STARTS})""",
)
def ordinal_partitions(t):
    found = partitions.ordinal_partitions(
        ordinal_rows(t), "machine", "ordinal", 15, 10, ORDINAL_CUTS
    )
    return found.select("machine", "ordinal", "partition")


# Chronological fractions of the ordinal study.
ORDINAL_CUTS = [("train", 0.0, 0.5), ("validation", 0.5, 0.7), ("evaluation", 0.7, 1.0)]


@query(
    "relative_minutes",
    """SELECT i.incident_id, t.service_id, t.timestamp,
         t.timestamp - INTERVAL 15 HOUR AS window_start, t.timestamp AS window_end,
         epoch(t.timestamp - i.incident_start) / 60.0::DOUBLE AS minutes_from_onset,
         epoch(t.timestamp - TIMESTAMP '2024-01-01') / 60.0::DOUBLE AS elapsed_minutes
       FROM telemetry AS t JOIN incidents AS i ON i.service_id = t.service_id
         AND t.timestamp >= i.precursor_start - INTERVAL 20 HOUR
         AND t.timestamp <= i.recovery_end + INTERVAL 20 HOUR""",
)
def relative_times(t):
    return relative_minutes(t.rollup, t.incidents, t.grid, margin_steps=20)


