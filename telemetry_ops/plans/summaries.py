"""Queries: operational summaries, merges, audits and descriptive statistics."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from telemetry_ops.grid import METRICS, moment
from telemetry_ops.operators import describe, features, summaries
from telemetry_ops.plans.registry import query
from telemetry_ops.plans.scoring import rounded
from telemetry_ops.plans.tables import CUTOFF, SCALES
from telemetry_ops.sources.events import INCIDENT_TYPES

START, END = datetime(2024, 1, 2), datetime(2024, 1, 30)
_RANGE = "timestamp >= TIMESTAMP '2024-01-02' AND timestamp < TIMESTAMP '2024-01-30'"


@query(
    "coverage",
    f"""SELECT s.service_id, CAST(672 AS BIGINT) AS expected_points,
          count(t.timestamp) AS observed_points, 672 - count(t.timestamp) AS missing_points
        FROM services AS s LEFT JOIN telemetry AS t ON t.service_id = s.service_id AND {_RANGE}
        GROUP BY s.service_id""",
)
def coverage(t):
    return summaries.coverage(t.services, t.telemetry, t.grid, START, END)


_RISK = """count(*) AS predictions, {extra} round(avg(probability), 9) AS mean_probability,
  min(probability) AS min_probability, max(probability) AS max_probability,
  round(quantile_cont(probability, 0.5), 9) AS median_probability"""


@query(
    "risk_summary",
    f"""SELECT service_id, model_id, {_RISK.format(extra="")} FROM stored_predictions
        WHERE {_RANGE} GROUP BY ALL""",
)
def risk_summary(t):
    found = summaries.risk_summary(t.stored_predictions, START, END)
    return rounded(found, "mean_probability", "median_probability")


@query(
    "latest_risk",
    """SELECT p.*, m.model_name, m.threshold, p.probability >= m.threshold AS elevated FROM (
         SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY service_id
             ORDER BY timestamp DESC, produced_at DESC, id) AS rank FROM stored_predictions)
         WHERE rank = 1) AS p JOIN models AS m USING (model_id)""",
)
def latest_risk(t):
    return summaries.latest_risk(t.stored_predictions, t.models)


@query(
    "daily_risk",
    f"""SELECT service_id, CAST(timestamp AS DATE) AS day, model_id,
          {_RISK.format(extra="count(*) FILTER (probability >= threshold) AS elevated_predictions,")}
        FROM stored_predictions JOIN models USING (model_id) GROUP BY ALL""",
)
def daily_risk(t):
    found = summaries.daily_risk(t.stored_predictions, t.models)
    return rounded(found, "mean_probability", "median_probability")


_JOINED = """SELECT p.*, m.* EXCLUDE (model_id),
  CASE WHEN p.probability >= m.threshold THEN 'elevated-risk' ELSE 'not-elevated-risk' END AS decision,
  p.timestamp - INTERVAL 15 HOUR AS window_start, p.timestamp AS window_end
  FROM stored_predictions AS p JOIN models AS m USING (model_id)"""


@query("prediction_join", _JOINED)
def prediction_join(t):
    return summaries.prediction_join(t.stored_predictions, t.models, t.grid)


@query(
    "prediction_history",
    f"""SELECT * FROM ({_JOINED}) WHERE timestamp >= TIMESTAMP '2024-01-05'
        ORDER BY timestamp DESC, id LIMIT 500""",
)
def prediction_history(t):
    joined = summaries.prediction_join(t.stored_predictions, t.models, t.grid)
    return summaries.prediction_history(joined, start=datetime(2024, 1, 5), limit=500)


@query(
    "ingest_merge",
    """WITH batch AS (SELECT service_id, timestamp, CASE WHEN step % 13 = 0 THEN error_rate / 2
              ELSE error_rate END AS error_rate, error_rate AS was, step FROM telemetry),
        old AS (SELECT * FROM telemetry WHERE step % 2 = 0)
       SELECT b.service_id, b.timestamp, b.error_rate,
         CASE WHEN b.timestamp > TIMESTAMP '2024-01-29' THEN 'future'
              WHEN o.step IS NOT NULL AND o.error_rate <> b.error_rate THEN 'conflict'
              WHEN o.step IS NOT NULL THEN 'unchanged' ELSE 'inserted' END AS status
       FROM batch AS b LEFT JOIN old AS o USING (service_id, timestamp)""",
)
def ingest_merge(t):
    """Every second step is stored; all steps arrive, some of them with another error rate."""
    changed = F.when(F.col("step") % 13 == 0, F.col("error_rate") / 2).otherwise(F.col("error_rate"))
    batch = t.rollup.withColumn("error_rate", changed)
    merged = summaries.ingest_merge(batch, t.rollup.where("step % 2 = 0"), CUTOFF)
    return merged.select("service_id", "timestamp", "error_rate", "status")


@query(
    "score_requests",
    """WITH req AS (SELECT service_id, timestamp, 'model-mean' AS model_id FROM telemetry),
        old AS (SELECT * FROM stored_predictions WHERE model_id = 'model-mean'
                AND produced_at <= TIMESTAMP '2024-01-15'),
        known AS (SELECT r.service_id, r.timestamp FROM telemetry AS r JOIN telemetry AS t
            ON t.service_id = r.service_id AND t.step BETWEEN r.step - 14 AND r.step
            AND t.ingested_at <= TIMESTAMP '2024-01-29' GROUP BY ALL HAVING count(*) = 15)
       SELECT service_id, timestamp, model_id, coalesce(o.probability, f.error_rate__mean) AS probability,
         o.id IS NULL AND f.error_rate__mean IS NOT NULL AS created
       FROM req LEFT JOIN old AS o USING (service_id, timestamp, model_id)
       LEFT JOIN (SELECT * FROM features_any_start SEMI JOIN known USING (service_id, timestamp)) AS f
         USING (service_id, timestamp)""",
)
def score_requests(t):
    """One request per telemetry key; half the month is already scored and keeps its scores."""
    keys = ["service_id", "timestamp", "model_id"]
    stored = t.stored_predictions.where(
        (F.col("model_id") == "model-mean") & (F.col("produced_at") <= moment(datetime(2024, 1, 15)))
    )
    requests = t.rollup.select("service_id", "timestamp", F.lit("model-mean").alias("model_id"))
    fresh = summaries.unscored_requests(requests, stored).withColumn("cutoff", moment(CUTOFF))
    built = features.point_in_time_features(fresh, t.rollup, t.grid, request_key=keys, scales=SCALES)
    scored = built.select(*keys, F.col("error_rate__mean").alias("probability"))
    return summaries.score_requests(requests, stored, scored)


@query(
    "parity_audit",
    f"""WITH l AS (SELECT * FROM features), r AS (SELECT * FROM features_any_start)
        {" UNION ALL ".join(f'''SELECT '{c}' AS "column", count(*) FILTER (l.service_id IS NOT NULL
            AND r.service_id IS NOT NULL) AS matched_rows,
          count(*) FILTER (r.service_id IS NULL) AS left_only,
          count(*) FILTER (l.service_id IS NULL) AS right_only, CAST(0 AS BIGINT) AS unequal,
          max(abs(l.{c} - r.{c})) AS max_error
        FROM l FULL JOIN r USING (service_id, timestamp)''' for c in features.FEATURES)}""",
)
def parity_audit(t):
    """Offline window features against point-in-time features, which have no coverage start."""
    requests = t.rollup.select("service_id", "timestamp", moment(datetime(2024, 3, 1)).alias("cutoff"))
    online = features.point_in_time_features(
        requests, t.rollup, t.grid, request_key=["service_id", "timestamp", "cutoff"], scales=SCALES
    ).where("missing_points = 0")
    offline = features.window_features(t.rollup, t.grid, scales=SCALES)
    return summaries.parity_audit(offline, online, ["service_id", "timestamp"], list(features.FEATURES))


@query(
    "latency_percentiles",
    """SELECT event_type, count(*) AS requests,
         count(*) FILTER (status = 'slow') AS status_slow, count(*) FILTER (status = 'ok') AS status_ok,
         min(value) AS min, round(quantile_cont(value, 0.5), 6) AS p50,
         round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max
       FROM (SELECT *, CASE WHEN value > 50 THEN 'slow' ELSE 'ok' END AS status FROM events)
       GROUP BY event_type""",
)
def latency_percentiles(t):
    rows = t.events.select(
        "event_type", "value", F.when(F.col("value") > 50, "slow").otherwise("ok").alias("status")
    )
    found = summaries.latency_percentiles(rows, ["event_type"], "value", "status", ["slow", "ok"])
    return rounded(found, "p50", "p95", digits=6)


# -- descriptive ----------------------------------------------------------------------------------


@query(
    "label_balance",
    """SELECT count(*) FILTER (y = 1) AS positive, count(*) FILTER (y = 0) AS negative,
         count(*) FILTER (y IS NULL) AS unknown, count(*) FILTER (NOT history_complete) AS history_incomplete,
         count(*) FILTER (history_complete AND horizon_complete) AS eligible_rows,
         count(*) FILTER (y = 1) / nullif(count(y), 0)::DOUBLE AS positive_fraction_observed,
         count(*) FILTER (y = 1 AND history_complete AND horizon_complete)
           / nullif(count(y) FILTER (history_complete AND horizon_complete), 0)::DOUBLE
           AS positive_fraction_eligible
       FROM (SELECT *, incident_within_horizon AS y FROM labelled)""",
)
def label_balance(t):
    return describe.label_balance(t.labels)


_DESCRIBED = list(METRICS)


@query(
    "describe_by_service",
    f"""SELECT service_id, metric, count(*) AS count, round(avg(value), 6) AS mean,
          round(stddev_samp(value), 6) AS std, min(value) AS min,
          round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
          round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max
        FROM (UNPIVOT (SELECT service_id, {", ".join(_DESCRIBED)} FROM telemetry)
              ON {", ".join(_DESCRIBED)} INTO NAME metric VALUE value) GROUP BY ALL""",
)
def describe_by_service(t):
    found = describe.describe_by(t.telemetry, ["service_id"], _DESCRIBED)
    return rounded(found, "mean", "std", "q25", "q50", "q75", digits=6)


@query(
    "correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS metric, '{b}' AS other, round(corr({a}, {b}), 9) AS r FROM telemetry"
        for a in _DESCRIBED
        for b in _DESCRIBED
    ),
)
def correlation(t):
    return rounded(describe.correlation(t.telemetry, _DESCRIBED), "r")


@query(
    "counts_by_type",
    f"""SELECT c.incident_type, count(i.incident_id) AS rows
        FROM (SELECT unnest([{", ".join(repr(x) for x in INCIDENT_TYPES)}]) AS incident_type) AS c
        LEFT JOIN incidents AS i USING (incident_type) GROUP BY c.incident_type""",
)
def counts_by_type(t):
    return describe.counts_by_category(t.incidents, "incident_type", list(INCIDENT_TYPES))


@query(
    "counts_by_service",
    """SELECT s.service_id, count(i.incident_id) AS rows FROM (SELECT DISTINCT service_id FROM telemetry) AS s
        LEFT JOIN incidents AS i USING (service_id) GROUP BY s.service_id""",
)
def counts_by_service(t):
    counts = t.incidents.groupBy("service_id").agg(F.count(F.lit(1)).alias("n"))
    return t.services.join(counts, "service_id", "left").select("service_id", F.coalesce("n", F.lit(0)).alias("rows"))


@query(
    "duration_stats",
    """SELECT min(m) AS min_minutes, round(avg(m), 9) AS mean_minutes, max(m) AS max_minutes FROM (
         SELECT epoch(incident_end - incident_start) / 60.0::DOUBLE AS m FROM incidents)""",
)
def duration_stats(t):
    return rounded(describe.duration_statistics(t.incidents), "mean_minutes")


_M = ", ".join(METRICS)


@query(
    "normal_segment",
    f"""SELECT t.service_id, t.timestamp, {_M} FROM telemetry AS t
        JOIN (SELECT service_id, min(timestamp) AS b FROM telemetry GROUP BY ALL) AS f USING (service_id)
        LEFT JOIN (SELECT service_id, min(precursor_start) AS p FROM incidents GROUP BY ALL) AS i
          USING (service_id)
        WHERE t.timestamp < least(b + INTERVAL 7200 MINUTE, p)""",
)
def normal_segment(t):
    found = describe.normal_segment(t.rollup, t.incidents, t.grid, minutes=7200)
    return found.select("service_id", "timestamp", *METRICS)


_CONTEXT = """SELECT t.*, i.incident_id, i.incident_type, i.precursor_start, i.incident_start,
    i.incident_end, i.recovery_end
  FROM telemetry AS t JOIN {source} AS i ON i.service_id = t.service_id
    AND t.timestamp >= i.precursor_start - INTERVAL 20 HOUR
    AND t.timestamp <= i.recovery_end + INTERVAL 20 HOUR"""

_EARLIEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_type
  ORDER BY incident_start, incident_id) AS rank FROM incidents) WHERE rank = 1)"""


@query(
    "incident_context",
    f"""SELECT service_id, timestamp, incident_id, incident_type, {_M}
        FROM ({_CONTEXT.format(source=_EARLIEST)})""",
)
def incident_context(t):
    first = describe.earliest_per_type(t.truth)
    found = describe.around_incidents(t.rollup, first, t.grid)
    return found.select("service_id", "timestamp", "incident_id", "incident_type", *METRICS)


@query(
    "phase_means",
    f"""SELECT incident_id, incident_type, phase, count(*) AS rows,
          {", ".join(f"round(avg({m}), 8) AS {m}" for m in _DESCRIBED)}
        FROM (SELECT *, CASE WHEN timestamp < precursor_start THEN 'baseline'
            WHEN timestamp < incident_start THEN 'precursor' WHEN timestamp < incident_end THEN 'active'
            WHEN timestamp < recovery_end THEN 'recovery'
            WHEN timestamp < recovery_end + INTERVAL 20 HOUR THEN 'post_recovery' END AS phase
          FROM ({_CONTEXT.format(source="incidents")})) WHERE phase IS NOT NULL GROUP BY ALL""",
)
def phase_means(t):
    found = describe.phase_means(t.rollup, t.truth, t.grid, _DESCRIBED)
    return rounded(found, *_DESCRIBED, digits=8)


@query(
    "histogram",
    """SELECT service_id, CAST(CASE WHEN hi > lo THEN
           least(floor((latency_p95_ms - lo) * 40 / (hi - lo)), 39) ELSE 0 END AS BIGINT) AS bin,
         count(*) AS rows
       FROM telemetry JOIN (SELECT service_id, min(latency_p95_ms) AS lo, max(latency_p95_ms) AS hi
                            FROM telemetry GROUP BY ALL) USING (service_id) GROUP BY ALL""",
)
def histogram(t):
    return describe.histogram(t.rollup, "service_id", "latency_p95_ms", 40)


@query(
    "even_sample",
    f"""SELECT service_id, timestamp, {_M} FROM (
          SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY timestamp) - 1 AS i,
            count(*) OVER (PARTITION BY service_id) AS n FROM telemetry)
        WHERE i IN (SELECT k * (n - 1) // 99 FROM range(100) AS x(k))""",
)
def even_sample(t):
    found = describe.even_sample(t.rollup, "service_id", t.grid, 100)
    return found.select("service_id", "timestamp", *METRICS)


@query(
    "head_tail",
    """WITH r AS (SELECT service_id, timestamp,
          row_number() OVER (PARTITION BY service_id ORDER BY timestamp) AS up,
          row_number() OVER (PARTITION BY service_id ORDER BY timestamp DESC) AS down FROM telemetry)
       SELECT 'head' AS slice, service_id, timestamp FROM r WHERE up <= 215
       UNION ALL SELECT 'tail', service_id, timestamp FROM r WHERE down <= 30
       UNION ALL SELECT 'first_timestamps', service_id, timestamp FROM r WHERE timestamp IN
         (SELECT DISTINCT timestamp FROM r ORDER BY timestamp LIMIT 46)""",
)
def head_tail(t):
    rows = t.rollup.select("service_id", "timestamp")
    parts = {
        "head": describe.head(rows, "service_id", t.grid, 215),
        "tail": describe.tail(rows, "service_id", t.grid, 30),
        "first_timestamps": describe.first_timestamps(rows, 46),
    }
    result = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("slice"), "service_id", "timestamp")
        result = part if result is None else result.unionByName(part)
    return result


_STRESS = ("latency_p50_ms", "latency_p95_ms", "dependency_latency_ms", "request_rate_rps")


@query(
    "shift_metrics",
    f"""SELECT service_id, timestamp + INTERVAL 7 DAY AS timestamp,
          {", ".join(f"{m} * 20.0::DOUBLE + 10000.0::DOUBLE AS {m}" for m in _STRESS)},
          0.95::DOUBLE AS error_rate, 99.0::DOUBLE AS cpu_utilisation_pct,
          99.0::DOUBLE AS memory_utilisation_pct FROM telemetry""",
)
def shift_metrics(t):
    return describe.shift_metrics(
        t.telemetry.select("service_id", "timestamp", *METRICS),
        scale={m: (20.0, 10000.0) for m in _STRESS},
        constants={"error_rate": 0.95, "cpu_utilisation_pct": 99.0, "memory_utilisation_pct": 99.0},
        move=timedelta(days=7),
    )
