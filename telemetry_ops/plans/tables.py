"""Input tables of the ready-made queries, all derived from the given ``events`` table.

``CTES`` states the same derivations in SQL for the cross-check.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_ops.functions.session import stage, use_utc
from telemetry_ops.grid import METRICS, TARGET, Grid, moment
from telemetry_ops.operators.features import labelled_features, window_features
from telemetry_ops.operators.labels import future_labels
from telemetry_ops.operators.partitions import assign_partitions
from telemetry_ops.operators.snapshots import identity, utc_text
from telemetry_ops.sources.events import (
    incidents_from_telemetry,
    service_of,
    telemetry_from_events,
)

ORIGIN = datetime(2024, 1, 1)
COVERAGE_END = datetime(2024, 1, 31)
HOURLY = Grid(ORIGIN, 3600, 15 * 3600, 10 * 3600)

# Fixed-point factors: percentiles of two-decimal values have four decimals.
SCALES = {m: 10_000 if m.endswith("_ms") else 1_000_000 for m in METRICS}

# Chronological stages as fractions of a development run.
STAGES = [
    ("train", 0.0, 0.4),
    ("calibration", 0.4, 0.6),
    ("validation", 0.6, 0.8),
    ("temporal_test", 0.8, 1.0),
]
RUN_STEPS = 240
THRESHOLD = 0.4
MODEL_THRESHOLDS = {"current": 0.5, "max": 0.8, "mean": 0.25}
CUTOFF = datetime(2024, 1, 29)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str, grid: Grid = HOURLY):
        self.spark, self.dir, self.grid = use_utc(spark), sf_dir, grid

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def telemetry(self) -> DataFrame:
        return telemetry_from_events(self.events, self.grid)

    @cached_property
    def rollup(self) -> DataFrame:
        """Telemetry staged as a table, for queries that read it more than once."""
        return stage(self.telemetry, "telemetry")

    @cached_property
    def services(self) -> DataFrame:
        return self.events.select(service_of().alias("service_id")).distinct()

    @cached_property
    def incidents(self) -> DataFrame:
        return incidents_from_telemetry(self.rollup, self.grid)

    @cached_property
    def labels(self) -> DataFrame:
        return future_labels(self.rollup, self.incidents, self.grid, coverage_end=COVERAGE_END)

    @cached_property
    def features(self) -> DataFrame:
        return window_features(self.telemetry, self.grid, scales=SCALES)

    # Runs: the month is cut into runs of equal length with their own coverage.
    def _run(self, timestamp):
        return F.concat(
            F.lit("run-"),
            F.call_function("div", self.grid.step(timestamp), F.lit(RUN_STEPS)).cast("string"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        last = (COVERAGE_END - ORIGIN) // timedelta(seconds=self.grid.step_seconds * RUN_STEPS)
        start = F.col("id") * RUN_STEPS
        return self.spark.range(last).select(
            F.concat(F.lit("run-"), F.col("id").cast("string")).alias("run_id"),
            F.when(F.col("id") == last - 1, "heldout_run").otherwise("development").alias("group"),
            self.grid.time(start).alias("start"),
            self.grid.time(start + RUN_STEPS).alias("end"),
        )

    def _with_run(self, df: DataFrame, timestamp: str) -> DataFrame:
        return df.withColumn("run_id", self._run(timestamp))

    @cached_property
    def run_telemetry(self) -> DataFrame:
        run = F.call_function("div", F.col("step"), F.lit(RUN_STEPS)) * RUN_STEPS
        return (
            self._with_run(self.rollup, "timestamp")
            .withColumn("run_start", self.grid.time(run))
            .withColumn("run_end", self.grid.time(run + RUN_STEPS))
        )

    @cached_property
    def run_incidents(self) -> DataFrame:
        return self._with_run(self.truth, "incident_start")

    @cached_property
    def truth(self) -> DataFrame:
        """Incidents staged as a table, for queries that read them more than once."""
        return stage(self.incidents, "incidents")

    @cached_property
    def error_features(self) -> DataFrame:
        """The error-rate features only, which is all the rule scores need."""
        return window_features(
            self.run_telemetry,
            self.grid,
            coverage_start="run_start",
            entity=("run_id", "service_id"),
            scales=SCALES,
            metrics=("error_rate",),
        )

    def _training_rows(self, metrics) -> DataFrame:
        rows = labelled_features(
            self.run_telemetry,
            self.run_incidents,
            self.grid,
            coverage_start="run_start",
            coverage_end="run_end",
            entity=("run_id", "service_id"),
            scales=SCALES,
            metrics=metrics,
        )
        return assign_partitions(rows, self.runs, self.grid, STAGES)

    @cached_property
    def modelling_rows(self) -> DataFrame:
        """Staged, because references, fits and scores all read it."""
        return stage(self._training_rows(METRICS), "modelling-rows")

    @cached_property
    def rule_rows(self) -> DataFrame:
        """Modelling rows with the error-rate features only, which the rule scores read."""
        return self._training_rows(("error_rate",))

    @cached_property
    def predictions(self) -> DataFrame:
        """Four rule scores in [0, 1] per modelling row, in long form; staged for its consumers."""
        current, mean, high = (F.col(f"error_rate__{s}") for s in ("current", "mean", "max"))
        sigmoid = F.round(1.0 / (1.0 + F.exp(2.0 - 4.0 * mean)), 6)
        scores = F.array(
            *[
                F.struct(F.lit(name).alias("candidate"), score.alias("probability"))
                for name, score in (
                    ("current_raw", current),
                    ("max_raw", high),
                    ("mean_raw", mean),
                    ("mean_sigmoid", sigmoid),
                )
            ]
        )
        rows = self.rule_rows.where(F.col("partition") != "purged").select(
            "run_id",
            "service_id",
            "timestamp",
            "partition",
            F.col(TARGET).alias("target"),
            F.inline(scores),
        )
        return stage(rows, "predictions")

    # Stored tables of the serving side: models, predictions, outcomes and snapshots.
    @cached_property
    def models(self) -> DataFrame:
        rows = F.array(
            *[
                F.struct(
                    F.lit(f"model-{name}").alias("model_id"),
                    F.lit(f"rule {name}").alias("model_name"),
                    F.lit("1.0").alias("feature_version"),
                    F.lit(threshold).alias("threshold"),
                )
                for name, threshold in MODEL_THRESHOLDS.items()
            ]
        )
        return self.spark.range(1).select(F.inline(rows))

    @cached_property
    def stored_predictions(self) -> DataFrame:
        rows = window_features(self.rollup, self.grid, scales=SCALES, metrics=("error_rate",))
        scores = F.array(
            *[
                F.struct(F.lit(f"model-{n}").alias("model_id"), F.col(f"error_rate__{n}").alias("probability"))
                for n in MODEL_THRESHOLDS
            ]
        )
        step = self.grid.step("timestamp")
        available = self.grid.time(step + 2)
        delay = F.pmod(step, F.lit(97)).cast("bigint")
        return rows.select("service_id", "timestamp", F.inline(scores)).select(
            F.concat_ws("-", "service_id", step.cast("string"), "model_id").alias("id"),
            "service_id",
            "timestamp",
            "model_id",
            available.alias("available_as_of"),
            F.timestamp_add("MINUTE", delay, available).alias("produced_at"),
            "probability",
        )

    @cached_property
    def incident_starts(self) -> DataFrame:
        step = self.grid.step("incident_start")
        return self.truth.select(
            F.col("incident_id").alias("source_id"),
            "service_id",
            F.col("incident_start").alias("start"),
            self.grid.time(step + F.pmod(step, F.lit(5)) + 1).alias("recorded_at"),
        )

    @cached_property
    def certificates(self) -> DataFrame:
        """Daily certificates ``(d, d+1]`` with days missing, and some that overlap two days."""
        number = F.regexp_extract("service_id", "([0-9]+)$", 1).cast("bigint")
        days = self.services.select(
            "service_id",
            number.alias("_number"),
            F.explode(F.sequence(F.lit(0), F.lit(29)).cast("array<bigint>")).alias("_day"),
        )
        daily = days.where((F.col("_day") + F.col("_number")) % 5 != 0).select(
            F.concat_ws("-", "service_id", F.lit("day"), "_day").alias("source_id"),
            "service_id",
            (F.col("_day") * 24).alias("_from"),
        )
        shifted = days.where((F.col("_day") + F.col("_number")) % 7 == 3).select(
            F.concat_ws("-", "service_id", F.lit("noon"), "_day").alias("source_id"),
            "service_id",
            (F.col("_day") * 24 + 12).alias("_from"),
        )
        at = F.col("_from")
        return daily.unionByName(shifted).select(
            "source_id",
            "service_id",
            self.grid.time(at).alias("start"),
            self.grid.time(at + 24).alias("end"),
            self.grid.time(at + 30).alias("recorded_at"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """One drift and one delayed snapshot per day and model, with a status from its scores."""
        day = F.call_function("div", self.grid.step("timestamp"), F.lit(24))
        high = F.try_divide(F.count_if(F.col("probability") >= 0.5), F.count(F.lit(1)))
        return (
            self.stored_predictions.groupBy("model_id", day.alias("_day"))
            .agg(F.count(F.lit(1)).alias("samples"), high.alias("_high"))
            .select(
                F.explode(F.array(F.lit("drift"), F.lit("delayed"))).alias("kind"),
                self.grid.time(F.col("_day") * 24).alias("start"),
                self.grid.time(F.col("_day") * 24 + 24).alias("end"),
                self.grid.time(F.col("_day") * 24 + 30).alias("cutoff"),
                "model_id",
                F.lit("reference-1").alias("reference_id"),
                "samples",
                F.when(F.col("samples") < 30, "insufficient")
                .when(F.col("_high") >= 0.25, "severe")
                .when(F.col("_high") >= 0.1, "warning")
                .otherwise("stable")
                .alias("status"),
            )
            .withColumn("_start", utc_text("start"))
            .withColumn("_end", utc_text("end"))
            .withColumn("_cutoff", utc_text("cutoff"))
            .withColumn("id", identity_of_snapshot())
            .drop("_start", "_end", "_cutoff")
        )


def identity_of_snapshot():
    """Identity over the kind, the interval, the UTC cutoff, the model and the reference."""
    texts = {"cutoff": F.col("_cutoff"), "end": F.col("_end"), "start": F.col("_start")}
    return identity(texts | {c: F.col(c) for c in ("kind", "model_id", "reference_id")})


_HOUR = "3600000000"
_US = "1704067200000000"


def _features_cte(source: str, entity: str, elapsed: str, earliest: int = 15) -> str:
    """SQL of the 49 statistics in the exact integer form."""
    scaled = ", ".join(f"CAST(round({m} * {SCALES[m]}) AS BIGINT) AS {m}" for m in METRICS)
    inner, outer = [], []
    for m in METRICS:
        k = f"{float(SCALES[m])}"
        inner += [
            f"CAST(sum({m}) OVER w AS BIGINT) AS {m}_s1",
            f"CAST(sum({m} * {m}) OVER w AS BIGINT) AS {m}_s2",
            f"CAST(sum({m} * {elapsed}) OVER w AS BIGINT) AS {m}_sx",
            f"min({m}) OVER w AS {m}_lo",
            f"max({m}) OVER w AS {m}_hi",
            f"first_value({m}) OVER w AS {m}_old",
        ]
        outer += [
            f"{m} / {k} AS {m}__current",
            f"{m}_s1 / (15 * {k}) AS {m}__mean",
            f"sqrt(CAST(15 * {m}_s2 - {m}_s1 * {m}_s1 AS DOUBLE)) / (15 * {k}) AS {m}__std",
            f"{m}_lo / {k} AS {m}__min",
            f"{m}_hi / {k} AS {m}__max",
            f"({m} - {m}_old) / {k} AS {m}__change",
            f"(2 * {m}_sx - (2 * {elapsed} - 14) * {m}_s1) / (560.0 * {k}) AS {m}__slope",
        ]
    columns = ", ".join(entity.split(", "))
    return f"""
      SELECT {columns}, timestamp, {", ".join(outer)} FROM (
        SELECT {columns}, timestamp, {elapsed}, count(*) OVER w AS points,
               {", ".join(METRICS)}, {", ".join(inner)}
        FROM (SELECT {columns}, timestamp, {elapsed}, {scaled} FROM {source})
        WINDOW w AS (PARTITION BY {columns} ORDER BY {elapsed}
                     RANGE BETWEEN 14 PRECEDING AND CURRENT ROW))
      WHERE points = 15 AND {elapsed} >= {earliest}"""


def _labels_cte(source: str, truth: str, entity: str, elapsed: str, total: int) -> str:
    on = " AND ".join(f"i.{c} = t.{c}" for c in entity.split(", "))
    mine = ", ".join(f"t.{c}" for c in entity.split(", "))
    return f"""
      SELECT {mine}, t.timestamp,
        (SELECT count(*) FROM {source} AS i
          WHERE {on} AND i.{elapsed} BETWEEN t.{elapsed} - 14 AND t.{elapsed}) = 15
          AND t.{elapsed} >= 15 AS history_complete,
        t.{elapsed} + 10 < {total} AS horizon_complete,
        CASE WHEN t.{elapsed} + 10 < {total} THEN
          CAST(EXISTS (SELECT 1 FROM {truth} AS i WHERE {on} AND i.incident_start > t.timestamp
             AND i.incident_start <= t.timestamp + INTERVAL 10 HOUR) AS BIGINT)
        END AS incident_within_horizon
      FROM {source} AS t"""


def _stage_case() -> str:
    parts = []
    for name, lower, upper in STAGES:
        low, high = int(RUN_STEPS * lower), int(RUN_STEPS * upper)
        parts.append(
            f"WHEN r.\"group\" = 'development' AND t.run_step - 15 >= {low} "
            f"AND t.run_step + 10 < {high} THEN '{name}'"
        )
    return (
        "CASE WHEN r.\"group\" <> 'development' AND t.run_step - 15 >= 0 "
        f"AND t.run_step + 10 < {RUN_STEPS} THEN r.\"group\" {' '.join(parts)} ELSE 'purged' END"
    )


_TEXT = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"

CTES: dict[str, str] = {
    "telemetry": f"""
      SELECT service_id, TIMESTAMP '2024-01-01' + to_hours(step) AS timestamp, step,
        n / 3600.0::DOUBLE AS request_rate_rps, round(p50, 4) AS latency_p50_ms, round(p95, 4) AS latency_p95_ms,
        errors / n::DOUBLE AS error_rate, k_sum / n::DOUBLE AS cpu_utilisation_pct,
        k_max::DOUBLE AS memory_utilisation_pct, value_max AS dependency_latency_ms,
        TIMESTAMP '2024-01-01' + to_hours(step + 1) + to_minutes(last_event % 97) AS ingested_at
      FROM (
        SELECT 'svc-' || (user_id // 38) AS service_id, (epoch_us(ts) - {_US}) // {_HOUR} AS step,
          count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95,
          count(*) FILTER (event_type = 'error') AS errors,
          sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum,
          max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max,
          max(value) AS value_max, max(event_id) AS last_event
        FROM events GROUP BY ALL)""",
    "services": "SELECT DISTINCT 'svc-' || (user_id // 38) AS service_id FROM events",
    "rated": """
      SELECT service_id, step, latency_p95_ms, cpu_utilisation_pct,
        CAST(round(error_rate * 1000000) AS BIGINT) AS rate FROM telemetry""",
    "incidents": """
      SELECT service_id || '-' || first_step AS incident_id, service_id,
        CASE WHEN p95 >= 60 THEN 'latency_spike' WHEN cpu >= 60 THEN 'cpu_saturation'
             ELSE 'error_burst' END AS incident_type,
        TIMESTAMP '2024-01-01' + to_hours(first_step - 2) AS precursor_start,
        TIMESTAMP '2024-01-01' + to_hours(first_step) AS incident_start,
        TIMESTAMP '2024-01-01' + to_hours(first_step + n) AS incident_end,
        TIMESTAMP '2024-01-01' + to_hours(first_step + n + 1) AS recovery_end,
        0.5::DOUBLE + rate / 1000000.0::DOUBLE AS severity
      FROM (
        SELECT service_id, min(step) AS first_step, count(*) AS n, max(rate) AS rate,
          max(latency_p95_ms) AS p95, max(cpu_utilisation_pct) AS cpu
        FROM (
          SELECT r.*, step - row_number() OVER (PARTITION BY service_id ORDER BY step) AS island
          FROM rated AS r JOIN (SELECT service_id, quantile_cont(rate, 0.97) AS lim
                                FROM rated GROUP BY service_id) AS q USING (service_id)
          WHERE rate >= lim AND rate > 0)
        GROUP BY service_id, island)""",
    "labelled": _labels_cte("telemetry", "incidents", "service_id", "step", 720),
    "features": _features_cte("telemetry", "service_id", "step"),
    "features_any_start": _features_cte("telemetry", "service_id", "step", 0),
    "known_telemetry": """
      SELECT * FROM telemetry WHERE timestamp > TIMESTAMP '2024-01-20 09:00:00'
        AND ingested_at <= TIMESTAMP '2024-01-31'""",
    "known_features": _features_cte("known_telemetry", "service_id", "step", 0),
    "runs": f"""
      SELECT 'run-' || r AS run_id,
        CASE WHEN r = 2 THEN 'heldout_run' ELSE 'development' END AS "group",
        TIMESTAMP '2024-01-01' + to_hours(r * {RUN_STEPS}) AS "start",
        TIMESTAMP '2024-01-01' + to_hours((r + 1) * {RUN_STEPS}) AS "end"
      FROM range(3) AS x(r)""",
    "run_telemetry": f"""
      SELECT 'run-' || (step // {RUN_STEPS}) AS run_id, step % {RUN_STEPS} AS run_step, *
      FROM telemetry""",
    "run_incidents": f"""
      SELECT 'run-' || ((epoch_us(incident_start) - {_US}) // {_HOUR} // {RUN_STEPS}) AS run_id, *
      FROM incidents""",
    "run_features": _features_cte("run_telemetry", "run_id, service_id", "run_step"),
    "run_labels": _labels_cte(
        "run_telemetry", "run_incidents", "run_id, service_id", "run_step", RUN_STEPS
    ),
    "modelling_rows": f"""
      SELECT f.*, l.incident_within_horizon, {_stage_case()} AS partition
      FROM run_features AS f JOIN run_labels AS l USING (run_id, service_id, timestamp)
      JOIN run_telemetry AS t USING (run_id, service_id, timestamp)
      JOIN runs AS r USING (run_id)
      WHERE l.history_complete AND l.horizon_complete AND l.incident_within_horizon IS NOT NULL""",
    "predictions": """
      SELECT run_id, service_id, timestamp, partition, incident_within_horizon AS target,
        unnest(['current_raw', 'max_raw', 'mean_raw', 'mean_sigmoid']) AS candidate,
        unnest([error_rate__current, error_rate__max, error_rate__mean,
                round(1.0 / (1.0 + exp(2.0 - 4.0 * error_rate__mean)), 6)]) AS probability
      FROM modelling_rows WHERE partition <> 'purged'""",
    "models": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('model-{n}', 'rule {n}', '1.0', {x}::DOUBLE)" for n, x in MODEL_THRESHOLDS.items()
    )
    + ") AS m(model_id, model_name, feature_version, threshold)",
    "stored_predictions": """
      SELECT service_id || '-' || h || '-' || model_id AS id, service_id, timestamp, model_id,
        timestamp + INTERVAL 2 HOUR AS available_as_of,
        timestamp + INTERVAL 2 HOUR + to_minutes(h % 97) AS produced_at, probability
      FROM (SELECT service_id, timestamp, date_diff('hour', TIMESTAMP '2024-01-01', timestamp) AS h,
              unnest(['model-current', 'model-max', 'model-mean']) AS model_id,
              unnest([error_rate__current, error_rate__max, error_rate__mean]) AS probability
            FROM features)""",
    "incident_starts": """
      SELECT incident_id AS source_id, service_id, incident_start AS "start",
        incident_start + to_hours(date_diff('hour', TIMESTAMP '2024-01-01', incident_start) % 5 + 1)
          AS recorded_at FROM incidents""",
    "certificates": """
      SELECT source_id, service_id, TIMESTAMP '2024-01-01' + to_hours(h) AS "start",
        TIMESTAMP '2024-01-01' + to_hours(h + 24) AS "end",
        TIMESTAMP '2024-01-01' + to_hours(h + 30) AS recorded_at
      FROM (
        SELECT service_id || '-day-' || d AS source_id, service_id, d * 24 AS h
        FROM services CROSS JOIN range(30) AS x(d)
        WHERE (d + CAST(replace(service_id, 'svc-', '') AS BIGINT)) % 5 <> 0
        UNION ALL
        SELECT service_id || '-noon-' || d, service_id, d * 24 + 12
        FROM services CROSS JOIN range(30) AS x(d)
        WHERE (d + CAST(replace(service_id, 'svc-', '') AS BIGINT)) % 7 = 3)""",
    "snapshots": f"""
      SELECT *, sha256('{{"cutoff":"' || {_TEXT.format("cutoff")} || '","end":"' || {_TEXT.format('"end"')}
          || '","kind":"' || kind || '","model_id":"' || model_id || '","reference_id":"'
          || reference_id || '","start":"' || {_TEXT.format('"start"')} || '"}}') AS id
      FROM (
        SELECT unnest(['drift', 'delayed']) AS kind,
          TIMESTAMP '2024-01-01' + to_hours(d * 24) AS "start",
          TIMESTAMP '2024-01-01' + to_hours(d * 24 + 24) AS "end",
          TIMESTAMP '2024-01-01' + to_hours(d * 24 + 30) AS cutoff,
          model_id, 'reference-1' AS reference_id, samples,
          CASE WHEN samples < 30 THEN 'insufficient' WHEN high >= 0.25 THEN 'severe'
               WHEN high >= 0.1 THEN 'warning' ELSE 'stable' END AS status
        FROM (SELECT model_id, date_diff('hour', TIMESTAMP '2024-01-01', timestamp) // 24 AS d,
                count(*) AS samples,
                count(*) FILTER (probability >= 0.5) / count(*)::DOUBLE AS high
              FROM stored_predictions GROUP BY ALL))""",
}


def training_rows(tables: Tables, coverage_end: datetime) -> DataFrame:
    """Features joined with their labels, eligible rows only."""
    return labelled_features(
        tables.rollup, tables.incidents, tables.grid, coverage_end=coverage_end, scales=SCALES
    )
