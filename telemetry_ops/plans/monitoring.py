"""Queries: drift, certified outcomes, health and snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from telemetry_ops.functions.session import stage
from telemetry_ops.grid import FEATURES, moment
from telemetry_ops.operators import drift, outcomes, snapshots
from telemetry_ops.plans.registry import query
from telemetry_ops.plans.scoring import _ROUNDED, _ap, _auc, _losses, _SUMMARY, rounded
from telemetry_ops.plans.tables import COVERAGE_END, CUTOFF, SCALES, THRESHOLD

CONFIG = drift.DriftConfig(minimum_samples=50)
COLUMNS = [*FEATURES, "probability"]
START, END = datetime(2024, 1, 21), COVERAGE_END


def _with_probability(rows):
    """The mean error rate stands in for a model's probability."""
    return rows.withColumn("probability", F.col("error_rate__mean"))


def _reference(t):
    rows = _with_probability(t.modelling_rows.where("partition = 'train'"))
    return drift.drift_reference(drift.to_long(rows, COLUMNS), CONFIG.bins)


def _long_sql(source: str, where: str) -> str:
    return f"""SELECT feature, value FROM (UNPIVOT
        (SELECT {", ".join(FEATURES)}, error_rate__mean AS probability FROM {source} WHERE {where})
        ON COLUMNS(*) INTO NAME feature VALUE value)"""


_LEVELS = ", ".join(str(i / 10) for i in range(11))
_REFERENCE = f"""ref_long AS MATERIALIZED ({_long_sql("modelling_rows", "partition = 'train'")}),
  edge AS (SELECT feature, count(*) AS samples,
             list_sort(list_distinct(quantile_cont(value, [{_LEVELS}]))) AS edges
           FROM ref_long GROUP BY feature),
  share AS (SELECT feature, len(list_filter(edges, lambda e: e <= value))
                + CAST(value > edges[-1] AS BIGINT) AS bin, count(*) AS n
            FROM ref_long JOIN edge USING (feature) GROUP BY ALL),
  reference AS (SELECT e.feature, b.bin, e.edges, e.samples,
                  coalesce(s.n, 0) / e.samples::DOUBLE AS expected
                FROM (SELECT *, unnest(range(len(edges) + 2)) AS bin FROM edge) AS b
                JOIN edge AS e USING (feature) LEFT JOIN share AS s
                  ON s.feature = b.feature AND s.bin = b.bin)"""


def _reference_rows(reference):
    return reference.select(
        "feature", "samples", "edges", F.posexplode("expected").alias("bin", "expected")
    ).select(
        "feature",
        F.col("bin").cast("bigint").alias("bin"),
        F.round(F.get("edges", F.col("bin")), 6).alias("edge"),
        "expected",
        "samples",
    )


_REFERENCE_ROWS = f"""WITH {_REFERENCE}
  SELECT feature, bin, round(edges[bin + 1], 6) AS edge, expected, samples FROM reference"""


@query("drift_reference", _REFERENCE_ROWS)
def drift_reference(t):
    return _reference_rows(_reference(t))


@query("training_reference", _REFERENCE_ROWS)
def training_reference(t):
    """The same reference, reached from an assignment table instead of labelled rows."""
    keys = ["run_id", "service_id", "timestamp"]
    rows = _with_probability(t.modelling_rows)
    assignments = stage(t.rule_rows.select(*keys, "partition"), "assignments")
    region = t.runs.where("group = 'development'").select("run_id")
    allowed = rows.join(F.broadcast(region), "run_id", "left_semi").select(*keys)  # as many runs as the month has
    found = drift.training_reference(rows, assignments, allowed, keys, COLUMNS, CONFIG.bins)
    return _reference_rows(found)


@query(
    "reference_checks",
    """SELECT unnest(['missing_feature', 'unexpected_feature', 'edges_not_finite',
         'edges_not_increasing', 'wrong_length', 'negative_share', 'shares_do_not_sum']) AS rule,
         unnest([1, 1, 0, 0, 0, 0, 0])::BIGINT AS rows
       FROM (SELECT count(*) AS n FROM modelling_rows WHERE partition = 'train')""",
)
def reference_checks(t):
    """The inventory misses one feature of the reference and names one that it lacks."""
    names = [*COLUMNS[:-1], "queue_depth"]
    table = t.spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"))
    return drift.reference_checks(_reference(t), table)


def _psi_sql(current: str) -> str:
    return f"""WITH {_REFERENCE}, cur AS MATERIALIZED ({current}),
        total AS (SELECT feature, count(*) AS n FROM cur GROUP BY feature),
        hit AS (SELECT feature, len(list_filter(edges, lambda e: e <= value))
                  + CAST(value > edges[-1] AS BIGINT) AS bin, count(*) AS n
                FROM cur JOIN edge USING (feature) GROUP BY ALL),
        s AS (SELECT r.feature, coalesce(t.n, 0) AS samples,
                coalesce(h.n, 0) / greatest(coalesce(t.n, 0), 1)::DOUBLE + 0.0001 AS a,
                r.expected + 0.0001 AS e
              FROM reference AS r LEFT JOIN hit AS h USING (feature, bin)
              LEFT JOIN total AS t USING (feature)),
        p AS (SELECT feature, samples, sum((a / sa - e / se) * ln((a / sa) / (e / se))) AS psi
              FROM (SELECT *, sum(a) OVER (PARTITION BY feature) AS sa,
                      sum(e) OVER (PARTITION BY feature) AS se FROM s) GROUP BY feature, samples),
        result AS (SELECT feature, CASE WHEN samples < 50 THEN 'insufficient'
            WHEN psi >= 0.25 THEN 'severe' WHEN psi >= 0.1 THEN 'warning' ELSE 'stable' END AS status,
          samples, CASE WHEN samples >= 50 THEN round(psi, 9) END AS psi FROM p)"""


_HELD_OUT = _long_sql("modelling_rows", "partition = 'heldout_run'")


def _psi(t):
    rows = _with_probability(t.modelling_rows.where("partition = 'heldout_run'"))
    return drift.population_stability(drift.to_long(rows, COLUMNS), _reference(t), CONFIG)


@query("psi_drift", f"{_psi_sql(_HELD_OUT)} SELECT * FROM result")
def psi_drift(t):
    return rounded(_psi(t), "psi")


_ORDER = "list_position(['stable', 'insufficient', 'warning', 'severe', 'invalid'], status)"


@query(
    "drift_status",
    f"""{_psi_sql(_HELD_OUT)}
      SELECT status, count(*) AS features,
        (SELECT arg_max(status, {_ORDER}) FROM result) AS overall FROM result GROUP BY status""",
)
def drift_status(t):
    results = _psi(t)
    counts = results.groupBy("status").agg(F.count(F.lit(1)).alias("features"))
    return counts.crossJoin(drift.overall_status(results).withColumnRenamed("status", "overall"))


@query(
    "drift_snapshot",
    _psi_sql(
        _long_sql("known_features", "timestamp >= TIMESTAMP '2024-01-21'").replace(
            ", error_rate__mean AS probability", ""
        )
        + """ UNION ALL SELECT 'probability' AS feature, probability AS value FROM stored_predictions
          WHERE model_id = 'model-mean' AND timestamp >= TIMESTAMP '2024-01-21'
            AND timestamp < TIMESTAMP '2024-01-31' AND produced_at <= TIMESTAMP '2024-01-31'"""
    )
    + " SELECT * FROM result",
)
def drift_snapshot(t):
    predictions = t.stored_predictions.where("model_id = 'model-mean'")
    return rounded(
        snapshots.drift_snapshot(
            t.rollup, predictions, _reference(t), t.grid, START, END, END, CONFIG, SCALES
        ),
        "psi",
    )


@query(
    "service_health",
    """WITH r AS (SELECT service_id, timestamp, epoch(ingested_at - timestamp)::DOUBLE AS lag FROM telemetry
         WHERE timestamp >= TIMESTAMP '2024-01-02' AND timestamp < TIMESTAMP '2024-01-29'
           AND ingested_at <= TIMESTAMP '2024-01-29')
       SELECT s.service_id, count(r.timestamp) AS rows, CAST(648 AS BIGINT) AS expected_points,
         648 - count(r.timestamp) AS missing_points, count(r.timestamp) / 648.0::DOUBLE AS grid_completeness,
         epoch(TIMESTAMP '2024-01-29' - max(r.timestamp))::DOUBLE AS event_freshness_seconds,
         min(lag) AS lag_min_seconds, quantile_cont(lag, 0.5) AS lag_median_seconds,
         max(lag) AS lag_max_seconds
       FROM services AS s LEFT JOIN r USING (service_id) GROUP BY s.service_id""",
)
def service_health(t):
    return snapshots.service_health(t.telemetry, t.services, t.grid, datetime(2024, 1, 2), CUTOFF, CUTOFF)


@query(
    "elevated_rate",
    f"""SELECT count(*) AS prediction_samples,
          count(*) FILTER (probability >= {THRESHOLD}) / nullif(count(*), 0)::DOUBLE AS elevated_risk_rate
        FROM stored_predictions WHERE timestamp >= TIMESTAMP '2024-01-02'
          AND timestamp < TIMESTAMP '2024-01-29' AND produced_at <= TIMESTAMP '2024-01-29'""",
)
def elevated_rate(t):
    rows = snapshots.scored_rows(t.stored_predictions, datetime(2024, 1, 2), CUTOFF, CUTOFF)
    return snapshots.elevated_rate(rows, THRESHOLD)


# -- outcomes -------------------------------------------------------------------------------------

_MERGED = """known AS (SELECT * FROM certificates WHERE recorded_at <= TIMESTAMP '2024-01-29'),
  merged AS (SELECT service_id, min("start") AS "start", max("end") AS "end" FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY service_id ORDER BY "start", "end", source_id) AS island
      FROM (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY service_id
                ORDER BY "start", "end", source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
              THEN 0 ELSE 1 END AS fresh FROM known)) GROUP BY service_id, island)"""


@query("merge_coverage", f"WITH {_MERGED} SELECT * FROM merged")
def merge_coverage(t):
    return outcomes.merge_coverage(t.certificates, t.grid, CUTOFF)


@query(
    "covered_horizons",
    f"""WITH {_MERGED} SELECT service_id, timestamp, EXISTS (SELECT 1 FROM merged AS m
          WHERE m.service_id = t.service_id AND m."start" <= t.timestamp
            AND m."end" >= t.timestamp + INTERVAL 10 HOUR) AS covered FROM telemetry AS t""",
)
def covered_horizons(t):
    merged = outcomes.merge_coverage(t.certificates, t.grid, CUTOFF)
    return outcomes.covered_horizons(t.telemetry.select("service_id", "timestamp"), merged, t.grid)


_DELAYED = f"""{_MERGED},
  delayed AS (SELECT *, CASE WHEN reason IS NULL THEN CAST(hit AS BIGINT) END AS target FROM (
    SELECT p.*, CASE WHEN produced_at > TIMESTAMP '2024-01-29' THEN 'unavailable_prediction'
        WHEN timestamp + INTERVAL 10 HOUR > TIMESTAMP '2024-01-29' THEN 'immature'
        WHEN NOT EXISTS (SELECT 1 FROM merged AS m WHERE m.service_id = p.service_id
          AND m."start" <= p.timestamp AND m."end" >= p.timestamp + INTERVAL 10 HOUR)
          THEN 'uncertified' END AS reason,
      EXISTS (SELECT 1 FROM incident_starts AS i WHERE i.service_id = p.service_id
        AND i.recorded_at <= TIMESTAMP '2024-01-29' AND i."start" > p.timestamp
        AND i."start" <= p.timestamp + INTERVAL 10 HOUR) AS hit
    FROM stored_predictions AS p))"""


def _delayed(t):
    return outcomes.delayed_labels(t.stored_predictions, t.incident_starts, t.certificates, t.grid, CUTOFF)


@query(
    "delayed_labels",
    f"WITH {_DELAYED} SELECT id, service_id, timestamp, model_id, probability, reason, target FROM delayed",
)
def delayed_labels(t):
    return _delayed(t).select(
        "id", "service_id", "timestamp", "model_id", "probability", "reason", "target"
    )


@query(
    "delayed_exclusions",
    f"""WITH {_DELAYED} SELECT r.reason, count(d.id) AS rows
        FROM (SELECT unnest(['unavailable_prediction', 'immature', 'uncertified']) AS reason) AS r
        LEFT JOIN delayed AS d USING (reason) GROUP BY r.reason""",
)
def delayed_exclusions(t):
    return outcomes.delayed_exclusions(_delayed(t))


def _delayed_metrics_sql() -> str:
    def figures(scope: str) -> str:
        hit = f"probability >= {THRESHOLD}"
        counts = f"""SELECT {scope} AS scope, count(*) FILTER (target = 1 AND {hit}) AS tp,
            count(*) FILTER (target = 0 AND {hit}) AS fp, count(*) FILTER (target = 1 AND NOT {hit}) AS fn,
            count(*) FILTER (target = 0 AND NOT {hit}) AS tn, count(*) AS n FROM eligible GROUP BY ALL"""
        events = f"""SELECT {scope} AS scope, count(*) AS scorable, count(lead) AS detected,
            avg(lead) AS mean_lead, quantile_cont(lead, 0.5) AS median_lead FROM (
              SELECT e.service_id, i.source_id, date_diff('microsecond',
                min(e.timestamp) FILTER ({hit}), i."start") / 60000000.0::DOUBLE AS lead
              FROM eligible AS e JOIN truth AS i ON i.service_id = e.service_id
                AND e.timestamp < i."start" AND e.timestamp >= i."start" - INTERVAL 10 HOUR
              GROUP BY e.service_id, i.source_id, i."start") GROUP BY ALL"""
        episodes = f"""SELECT {scope} AS scope, count(*) AS episodes, count(*) FILTER (warned) AS matched,
            CAST(sum(points) AS BIGINT) AS alerts FROM (
              SELECT service_id, island, bool_or(warned) AS warned, count(*) AS points FROM (
                SELECT e.*, EXISTS (SELECT 1 FROM truth AS i WHERE i.service_id = e.service_id
                    AND e.timestamp < i."start" AND e.timestamp >= i."start" - INTERVAL 10 HOUR) AS warned,
                  date_diff('hour', TIMESTAMP '2024-01-01', timestamp)
                    - row_number() OVER (PARTITION BY service_id ORDER BY timestamp) AS island
                FROM eligible AS e WHERE {hit}) GROUP BY ALL) GROUP BY ALL"""
        ranked = f"(SELECT {scope} AS scope, * FROM eligible)"
        return f"""SELECT c.scope, tp, fp, fn, tn, tp + fp + fn + tn AS rows, tp + fn AS positives,
            (tp + fn) / nullif(n, 0)::DOUBLE AS prevalence, tp / nullif(tp + fp, 0)::DOUBLE AS precision,
            tp / nullif(tp + fn, 0)::DOUBLE AS recall, average_precision, roc_auc, brier, log_loss,
            {_SUMMARY}, coalesce(alerts, 0) / nullif(n, 0)::DOUBLE AS alert_row_fraction
          FROM ({counts}) AS c LEFT JOIN ({_ap("scope", ranked)}) USING (scope)
          LEFT JOIN ({_auc("scope", ranked)}) USING (scope) LEFT JOIN ({_losses("scope", ranked)}) USING (scope)
          LEFT JOIN ({events}) USING (scope) LEFT JOIN ({episodes}) USING (scope)"""

    return f"""WITH {_DELAYED},
        eligible AS (SELECT service_id, timestamp, probability, target FROM delayed
                     WHERE model_id = 'model-mean' AND reason IS NULL),
        truth AS (SELECT * FROM incident_starts WHERE recorded_at <= TIMESTAMP '2024-01-29'),
        scopes AS (SELECT service_id AS scope FROM services UNION ALL SELECT 'all')
        SELECT s.scope, f.* EXCLUDE (scope),
          CASE WHEN coalesce(f.rows, 0) > 0 THEN 'evaluated' ELSE 'insufficient' END AS status
        FROM scopes AS s LEFT JOIN ({figures("'all'")} UNION ALL {figures("service_id")}) AS f
          ON f.scope = s.scope"""


@query("delayed_metrics", _delayed_metrics_sql())
def delayed_metrics(t):
    one_model = t.stored_predictions.where("model_id = 'model-mean'")
    labelled = outcomes.delayed_labels(one_model, t.incident_starts, t.certificates, t.grid, CUTOFF)
    labelled = stage(labelled, "delayed-labels")
    found = outcomes.delayed_metrics(labelled, t.incident_starts, t.services, t.grid, CUTOFF, THRESHOLD)
    return rounded(found, "average_precision", "roc_auc", "brier", "log_loss", *_ROUNDED)


@query(
    "import_outcomes",
    """WITH batch AS (SELECT source_id, service_id, CASE WHEN h % 11 = 0
              THEN "start" + INTERVAL 7 MINUTE ELSE "start" END AS "start", h
            FROM (SELECT *, date_diff('hour', TIMESTAMP '2024-01-01', "start") AS h FROM incident_starts)),
        old AS (SELECT * FROM incident_starts WHERE date_diff('hour', TIMESTAMP '2024-01-01', "start") % 3 = 0),
        certs AS (SELECT * FROM certificates WHERE recorded_at <= TIMESTAMP '2024-01-20')
       SELECT b.source_id, b.service_id, b."start", CAST(1 AS BIGINT) AS records,
         CASE WHEN b."start" > TIMESTAMP '2024-01-29' THEN 'future'
              WHEN o.source_id IS NOT NULL AND o."start" <> b."start" THEN 'conflict'
              WHEN o.source_id IS NOT NULL THEN 'unchanged'
              WHEN EXISTS (SELECT 1 FROM certs AS c WHERE c.service_id = b.service_id
                AND c."start" < b."start" AND c."end" >= b."start") THEN 'contradiction'
              ELSE 'new' END AS status
       FROM batch AS b LEFT JOIN old AS o USING (source_id)""",
)
def import_outcomes(t):
    """A third of the registry is stored; the whole registry arrives, some records altered."""
    hour = t.grid.step("start")
    altered = F.timestamp_add("MINUTE", F.lit(7).cast("bigint"), F.col("start"))
    batch = t.incident_starts.select(
        "source_id", "service_id", F.when(hour % 11 == 0, altered).otherwise(F.col("start")).alias("start")
    )
    stored = t.incident_starts.where(hour % 3 == 0)
    known = t.certificates.where(F.col("recorded_at") <= moment(datetime(2024, 1, 20)))
    incidents, _ = outcomes.import_outcomes(batch, t.certificates, stored, known, t.grid, CUTOFF)
    return incidents


@query("snapshot_identity", "SELECT id, kind, \"start\", \"end\", cutoff, model_id, reference_id FROM snapshots")
def snapshot_identity(t):
    return t.snapshots.select("id", "kind", "start", "end", "cutoff", "model_id", "reference_id")


@query(
    "broken_seals",
    """SELECT id, samples + 1 AS samples FROM snapshots WHERE samples % 7 = 3
       UNION ALL SELECT id, samples FROM snapshots WHERE samples % 7 = 4""",
)
def broken_seals(t):
    """Sealed snapshots, stored; some lose a sample's worth of truth afterwards, some their seal."""
    stored = snapshots.sealed(t.snapshots)
    kind = F.col("samples") % 7
    hurt = stored.withColumn("seal", F.when(kind != 4, F.col("seal"))).withColumn(
        "samples", F.when(kind == 3, F.col("samples") + 1).otherwise(F.col("samples"))
    )
    return snapshots.broken_seals(hurt).select("id", "samples")


@query(
    "snapshot_history",
    """SELECT * FROM snapshots WHERE kind = 'drift' AND "start" >= TIMESTAMP '2024-01-03'
       ORDER BY cutoff DESC, id LIMIT 50""",
)
def snapshot_history(t):
    return snapshots.snapshot_history(t.snapshots, "drift", start=datetime(2024, 1, 3), limit=50)

