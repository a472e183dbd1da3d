"""Queries: rule scores, row metrics, alert episodes, incidents and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetry_ops.functions.session import new_folder
from telemetry_ops.grid import TARGET
from telemetry_ops.operators import bootstrap, episodes, experiment, scores
from telemetry_ops.plans.registry import query
from telemetry_ops.plans.tables import STAGES, THRESHOLD

GROUP = ["partition", "candidate"]
BUDGET = 0.3


def rounded(df, *names, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query(
    "prevalence_score",
    """SELECT run_id, service_id, timestamp, partition, incident_within_horizon AS target,
         round((SELECT avg(incident_within_horizon) FROM modelling_rows WHERE partition = 'train'), 12)
           AS probability
       FROM modelling_rows""",
)
def prevalence_score(t):
    rows = t.rule_rows.select(
        "run_id", "service_id", "timestamp", "partition", F.col(TARGET).alias("target")
    )
    return rounded(
        scores.prevalence_score(rows.where("partition = 'train'"), rows), "probability", digits=12
    )


@query(
    "decision",
    f"""SELECT run_id, service_id, timestamp, candidate, probability, {THRESHOLD} AS threshold,
         CASE WHEN probability >= {THRESHOLD} THEN 'elevated-risk' ELSE 'not-elevated-risk' END AS decision
       FROM (SELECT * REPLACE (CAST(probability AS DOUBLE) AS probability) FROM predictions)""".replace(
        f"{THRESHOLD} AS threshold", f"{THRESHOLD}::DOUBLE AS threshold"
    ),
)
def decision(t):
    rows = t.predictions.select(
        "run_id", "service_id", "timestamp", "candidate", "probability", F.lit(THRESHOLD).alias("threshold")
    )
    return scores.decision(rows)


@query(
    "candidate_scores",
    """SELECT run_id, service_id, timestamp, unnest(['current', 'max', 'mean']) AS candidate,
         unnest([error_rate__current, error_rate__max, error_rate__mean]) AS probability
       FROM run_features""",
)
def candidate_scores(t):
    keys = ["run_id", "service_id", "timestamp"]
    wide = t.error_features.select(
        *keys, *[F.col(f"error_rate__{s}").alias(s) for s in ("current", "max", "mean")]
    )
    return scores.stack_candidates(wide, keys, ["current", "max", "mean"])


_COUNTS = f"""count(*) FILTER (target = 1 AND probability >= {THRESHOLD}) AS tp,
  count(*) FILTER (target = 0 AND probability >= {THRESHOLD}) AS fp,
  count(*) FILTER (target = 1 AND probability < {THRESHOLD}) AS fn,
  count(*) FILTER (target = 0 AND probability < {THRESHOLD}) AS tn"""

_RATES = """tp, fp, fn, tn, tp + fp + fn + tn AS rows, tp + fn AS positives,
  (tp + fn) / nullif(tp + fp + fn + tn, 0)::DOUBLE AS prevalence,
  tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall"""


@query(
    "row_metrics",
    f"""SELECT partition, candidate, {_RATES} FROM (
          SELECT partition, candidate, {_COUNTS} FROM predictions GROUP BY ALL)""",
)
def row_metrics(t):
    return scores.confusion_metrics(t.predictions, GROUP, THRESHOLD)


def _ranked(by: str, source: str = "predictions") -> str:
    return f"""SELECT {by}, probability, n, pos,
        CAST(sum(n) OVER d AS BIGINT) AS cn, CAST(sum(pos) OVER d AS BIGINT) AS cp,
        CAST(sum(n) OVER (PARTITION BY {by}) AS BIGINT) AS all_n,
        CAST(sum(pos) OVER (PARTITION BY {by}) AS BIGINT) AS all_p
      FROM (SELECT {by}, probability, count(*) AS n, CAST(sum(target) AS BIGINT) AS pos
            FROM {source} GROUP BY ALL)
      WINDOW d AS (PARTITION BY {by} ORDER BY probability DESC)"""


def _ap(by: str, source: str = "predictions") -> str:
    return f"""SELECT {by}, round(CASE WHEN max(all_p) > 0 THEN
          sum(pos / all_p::DOUBLE * (cp / cn::DOUBLE)) END, 9) AS average_precision
        FROM ({_ranked(by, source)}) GROUP BY ALL"""


def _auc(by: str, source: str = "predictions") -> str:
    return f"""SELECT {by}, round(CASE WHEN max(all_p) > 0 AND max(all_n) > max(all_p) THEN
          sum(pos * (2 * (all_n - all_p - (cn - cp)) + n - pos))::DOUBLE
            / (2.0::DOUBLE * max(all_p) * (max(all_n) - max(all_p))) END, 9) AS roc_auc
        FROM ({_ranked(by, source)}) GROUP BY ALL"""


_EPS = "2.220446049250313e-16"


def _losses(by: str, source: str = "predictions") -> str:
    clipped = f"least(greatest(probability, {_EPS}), 1 - {_EPS})"
    return f"""SELECT {by}, round(avg((probability - target) * (probability - target)), 9) AS brier,
          round(avg(CASE WHEN target = 1 THEN -ln({clipped}) ELSE -ln(1 - {clipped}) END), 9) AS log_loss
        FROM {source} GROUP BY ALL"""


@query("average_precision", _ap("partition, candidate"))
def average_precision(t):
    return rounded(scores.average_precision(t.predictions, GROUP), "average_precision")


@query("roc_auc", _auc("partition, candidate"))
def roc_auc(t):
    return rounded(scores.roc_auc(t.predictions, GROUP), "roc_auc")


@query("brier_logloss", _losses("partition, candidate"))
def brier_logloss(t):
    return rounded(scores.brier_log_loss(t.predictions, GROUP), "brier", "log_loss")


@query(
    "pr_curve",
    f"""SELECT partition, candidate, probability AS threshold, cp AS tp, cn - cp AS fp,
          cp / cn::DOUBLE AS precision, cp / nullif(all_p, 0)::DOUBLE AS recall
        FROM ({_ranked("partition, candidate")})""",
)
def pr_curve(t):
    return scores.precision_recall_curve(t.predictions, GROUP)


@query(
    "reliability_bins",
    """WITH b AS (SELECT r AS bin, r / 10.0::DOUBLE AS lower, (r + 1) / 10.0::DOUBLE AS upper FROM range(10) AS x(r)),
       g AS (SELECT DISTINCT partition, candidate FROM predictions)
       SELECT g.partition, g.candidate, bin, lower, upper, count(p.target) AS rows,
         CAST(coalesce(sum(p.target), 0) AS BIGINT) AS positives,
         round(avg(p.probability) + 1e-12, 9) AS mean_probability,
         sum(p.target) / nullif(count(p.target), 0)::DOUBLE AS observed_fraction
       FROM g CROSS JOIN b LEFT JOIN predictions AS p ON p.partition = g.partition
         AND p.candidate = g.candidate AND (p.probability > lower OR (bin = 0 AND p.probability = 0))
         AND p.probability <= upper
       GROUP BY ALL""",
)
def reliability_bins(t):
    table = scores.reliability_table(t.predictions, GROUP)
    # The nudge keeps exact decimal ties from depending on the order of summation.
    return rounded(table.withColumn("mean_probability", F.col("mean_probability") + 1e-12), "mean_probability")


# -- operational ----------------------------------------------------------------------------------


def _episodes(by: str, threshold: str, source: str = "predictions", extra: str = "") -> str:
    """Islands of alerted hours; matched if an alerted hour precedes an onset by at most 10 hours."""
    return f"""SELECT {by}, {extra} min(timestamp) AS "start", max(timestamp) AS "end",
        count(*) AS alert_points, bool_or(warned) AS matched FROM (
      SELECT p.*, EXISTS (SELECT 1 FROM run_incidents AS i WHERE i.run_id = p.run_id
            AND i.service_id = p.service_id AND p.timestamp < i.incident_start
            AND p.timestamp >= i.incident_start - INTERVAL 10 HOUR) AS warned,
        date_diff('hour', TIMESTAMP '2024-01-01', timestamp)
          - row_number() OVER (PARTITION BY {extra} {by} ORDER BY timestamp) AS island
      FROM {source} AS p WHERE probability >= {threshold}) GROUP BY {extra} {by}, island"""


def _results(by: str, threshold: str, source: str = "predictions", extra: str = "") -> str:
    keys = ", ".join(f"p.{c.strip()}" for c in (extra + by).split(","))
    return f"""SELECT {keys}, i.incident_id, i.incident_type,
        coalesce(bool_or(probability >= {threshold}), false) AS detected,
        date_diff('microsecond', min(timestamp) FILTER (probability >= {threshold}), i.incident_start)
          / 60000000.0::DOUBLE AS lead_minutes
      FROM {source} AS p JOIN run_incidents AS i ON i.run_id = p.run_id AND i.service_id = p.service_id
        AND p.timestamp < i.incident_start AND p.timestamp >= i.incident_start - INTERVAL 10 HOUR
      GROUP BY {keys}, i.incident_id, i.incident_type, i.incident_start"""


_PLACE = "partition, candidate, run_id, service_id"


@query("alert_episodes", _episodes(_PLACE, str(THRESHOLD)))
def alert_episodes(t):
    return episodes.alert_episodes(t.predictions, t.run_incidents, t.grid, GROUP, THRESHOLD)


@query("incident_detection", _results(_PLACE, str(THRESHOLD)))
def incident_detection(t):
    return episodes.incident_results(t.predictions, t.run_incidents, t.grid, GROUP, THRESHOLD)


@query(
    "episode_matching",
    f"""SELECT partition, candidate, matched, count(*) AS episodes,
          CAST(sum(alert_points) AS BIGINT) AS alert_points
        FROM ({_episodes(_PLACE, str(THRESHOLD))}) GROUP BY ALL""",
)
def episode_matching(t):
    found = episodes.alert_episodes(t.predictions, t.run_incidents, t.grid, GROUP, THRESHOLD)
    return found.groupBy(*GROUP, "matched").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("alert_points").alias("alert_points")
    )


_SUMMARY = """coalesce(scorable, 0) AS scorable_incidents, coalesce(detected, 0) AS detected_incidents,
  coalesce(scorable, 0) - coalesce(detected, 0) AS missed_incidents,
  detected / nullif(scorable, 0)::DOUBLE AS incident_detection_rate,
  round(mean_lead, 9) AS mean_lead_minutes, median_lead AS median_lead_minutes,
  coalesce(episodes, 0) AS episodes, coalesce(episodes, 0) - coalesce(matched, 0) AS false_episodes,
  matched / nullif(episodes, 0)::DOUBLE AS alert_precision,
  round(n * (3600 / 86400.0::DOUBLE), 9) AS eligible_service_days,
  round((coalesce(episodes, 0) - coalesce(matched, 0)) / (n * (3600 / 86400.0::DOUBLE)), 9)
    AS false_alerts_per_service_day,
  coalesce(alerts, 0) * 60.0::DOUBLE AS alert_minutes"""


def _operational(by: str, threshold: str, source: str = "predictions", extra: str = "") -> str:
    """Exposure, events and episodes per group; ``by`` must name partition and candidate first."""
    place = ", ".join(dict.fromkeys([c.strip() for c in by.split(",")] + ["run_id", "service_id"]))
    group = (extra + by).strip()
    return f"""SELECT {group}, {_SUMMARY} FROM
        (SELECT {group}, count(*) AS n FROM {source} GROUP BY ALL)
        LEFT JOIN (SELECT {group}, count(*) AS scorable, count(*) FILTER (detected) AS detected,
            avg(lead_minutes) AS mean_lead, quantile_cont(lead_minutes, 0.5) AS median_lead
          FROM ({_results(place, threshold, source, extra)}) GROUP BY ALL) USING ({group})
        LEFT JOIN (SELECT {group}, count(*) AS episodes, count(*) FILTER (matched) AS matched,
            CAST(sum(alert_points) AS BIGINT) AS alerts
          FROM ({_episodes(place, threshold, source, extra)}) GROUP BY ALL) USING ({group})"""


_ROUNDED = ("mean_lead_minutes", "eligible_service_days", "false_alerts_per_service_day")


@query("operational_summary", _operational("partition, candidate", str(THRESHOLD)))
def operational_summary(t):
    found = episodes.operational_summary(t.predictions, t.run_incidents, t.grid, GROUP, THRESHOLD)
    return rounded(found, *_ROUNDED)


_LEVELS = ", ".join(repr(x) + "::DOUBLE" for x in episodes.default_thresholds())
_SWEPT = f"""(SELECT p.*, threshold FROM
  (SELECT * FROM predictions WHERE partition = 'validation') AS p
  CROSS JOIN (SELECT unnest([{_LEVELS}]) AS threshold))"""


def _sweep_sql() -> str:
    return f"""SELECT candidate, threshold, c.tp, c.fp, c.fn, c.tn,
        tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall,
        o.* EXCLUDE (candidate, threshold)
      FROM (SELECT candidate, threshold,
          count(*) FILTER (target = 1 AND probability >= threshold) AS tp,
          count(*) FILTER (target = 0 AND probability >= threshold) AS fp,
          count(*) FILTER (target = 1 AND probability < threshold) AS fn,
          count(*) FILTER (target = 0 AND probability < threshold) AS tn
        FROM swept GROUP BY ALL) AS c
      JOIN ({_operational("candidate", "threshold", "swept", "threshold, ")}) AS o
        USING (candidate, threshold)"""


def _with_swept(body: str) -> str:
    return f"WITH swept AS {_SWEPT} {body}"


def _validation_sweep(t):
    rows = t.predictions.where("partition = 'validation'")
    return episodes.threshold_sweep(
        rows, t.run_incidents, t.grid, ["candidate"], episodes.default_thresholds()
    )


@query("threshold_sweep", _with_swept(_sweep_sql()))
def threshold_sweep(t):
    return rounded(_validation_sweep(t), *_ROUNDED)


@query(
    "select_threshold",
    _with_swept(
        f"""SELECT candidate, threshold, incident_detection_rate, false_alerts_per_service_day, alert_minutes
        FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY
                incident_detection_rate DESC NULLS LAST, alert_minutes, threshold DESC) AS rank
              FROM ({_operational("candidate", "threshold", "swept", "threshold, ")})
              WHERE false_alerts_per_service_day <= {BUDGET}) WHERE rank = 1"""
    ),
)
def select_threshold(t):
    best = scores.select_threshold(rounded(_validation_sweep(t), *_ROUNDED), ["candidate"], BUDGET)
    return best.select(
        "candidate", "threshold", "incident_detection_rate", "false_alerts_per_service_day", "alert_minutes"
    )


@query(
    "choose_model",
    f"""WITH v AS (SELECT * FROM predictions WHERE partition = 'validation'),
        m AS (SELECT *, regexp_replace(candidate, '_(raw|sigmoid)$', '') AS family
              FROM ({_ap("candidate", "v")}) JOIN ({_losses("candidate", "v")}) USING (candidate)),
        best AS (SELECT * FROM m WHERE candidate LIKE '%\\_raw' ESCAPE '\\'
                 ORDER BY average_precision DESC NULLS LAST, log_loss, candidate LIMIT 1)
        SELECT b.family, CASE WHEN s.brier < b.brier AND s.log_loss < b.log_loss
                              THEN s.candidate ELSE b.candidate END AS selected
        FROM best AS b LEFT JOIN m AS s ON s.family = b.family AND s.candidate = b.family || '_sigmoid'""",
)
def choose_model(t):
    rows = t.predictions.where("partition = 'validation'")
    table = scores.average_precision(rows, ["candidate"]).join(
        scores.brier_log_loss(rows, ["candidate"]), "candidate"
    )
    return scores.choose_model(rounded(table, "average_precision", "brier", "log_loss"))


#: Rule scores reach 1, so that only a level above it raises no alert at all.
_NO_ALERT = 2.0
_FROZEN = f"""swept AS {_SWEPT.replace("]) AS threshold", f", {_NO_ALERT}::DOUBLE]) AS threshold")},
  v AS (SELECT * FROM predictions WHERE partition = 'validation'),
  m AS (SELECT *, regexp_replace(candidate, '_(raw|sigmoid)$', '') AS family
        FROM ({_ap("candidate", "v")}) JOIN ({_losses("candidate", "v")}) USING (candidate)),
  best AS (SELECT * FROM m WHERE candidate LIKE '%\\_raw' ESCAPE '\\'
           ORDER BY average_precision DESC NULLS LAST, log_loss, candidate LIMIT 1),
  choice AS (SELECT CASE WHEN s.brier < b.brier AND s.log_loss < b.log_loss THEN s.candidate ELSE b.candidate END AS selected
             FROM best AS b LEFT JOIN m AS s ON s.family = b.family AND s.candidate = b.family || '_sigmoid'),
  cuts AS (SELECT candidate, threshold FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY
              incident_detection_rate DESC NULLS LAST, alert_minutes, threshold DESC) AS rank
            FROM ({_operational("candidate", "threshold", "swept", "threshold, ")})
            WHERE false_alerts_per_service_day <= {BUDGET}) WHERE rank = 1),
  held AS (SELECT p.*, threshold, candidate = (SELECT selected FROM choice) AS selected
           FROM predictions AS p JOIN cuts USING (candidate) WHERE partition IN ('temporal_test', 'heldout_run'))"""


@query(
    "select_then_score",
    f"""WITH {_FROZEN}
      SELECT c.*, o.* EXCLUDE (partition, candidate), average_precision, brier, log_loss
      FROM (SELECT partition, candidate, any_value(threshold) AS threshold, any_value(selected) AS selected, count(*) AS rows,
          count(*) FILTER (target = 1 AND probability >= threshold) AS tp, count(*) FILTER (target = 0 AND probability >= threshold) AS fp,
          count(*) FILTER (target = 1 AND probability < threshold) AS fn, count(*) FILTER (target = 0 AND probability < threshold) AS tn
        FROM held GROUP BY ALL) AS c
      JOIN ({_operational("partition, candidate", "threshold", "held")}) AS o USING (partition, candidate)
      JOIN ({_ap("partition, candidate", "held")}) USING (partition, candidate)
      JOIN ({_losses("partition, candidate", "held")}) USING (partition, candidate)""",
)
def select_then_score(t):
    """Model and thresholds are chosen on validation rows and frozen; held-out rows are scored by the record alone."""
    path = new_folder(t.spark, "selection")
    validation, levels = t.predictions.where("partition = 'validation'"), [*episodes.default_thresholds(), _NO_ALERT]
    experiment.freeze_selection(validation, t.run_incidents, t.grid, BUDGET, path, thresholds=levels)
    held = t.predictions.where(F.col("partition").isin("temporal_test", "heldout_run"))
    scored = experiment.score_held_out(t.spark, path, held, lambda rows: rows)
    found = experiment.held_out_metrics(scored, t.run_incidents, t.grid)
    names = (*_ROUNDED, "average_precision", "brier", "log_loss")
    return rounded(found.drop("prevalence", "positives", "precision", "recall", "roc_auc"), *names)


def _all_metrics(by: str) -> str:
    return f"""SELECT * FROM (SELECT {by}, {_RATES} FROM (SELECT {by}, {_COUNTS}
            FROM predictions GROUP BY ALL))
        JOIN ({_ap(by)}) USING ({by}) JOIN ({_auc(by)}) USING ({by}) JOIN ({_losses(by)}) USING ({by})
        JOIN ({_operational(by, str(THRESHOLD))}) USING ({by})"""


@query(
    "metrics_by_group",
    f"""SELECT 'partition-candidate' AS grouping, NULL::VARCHAR AS service_id, *
        FROM ({_all_metrics("partition, candidate")})
        UNION ALL BY NAME
        SELECT 'partition-service' AS grouping, *
        FROM ({_all_metrics("partition, candidate, service_id")})""",
)
def metrics_by_group(t):
    """Two separate groupings of the same operators."""
    parts = []
    for name, by in (("partition-candidate", GROUP), ("partition-service", [*GROUP, "service_id"])):
        rows = scores.row_metrics(t.predictions, by, THRESHOLD)
        operational = episodes.operational_summary(t.predictions, t.run_incidents, t.grid, by, THRESHOLD)
        both = rounded(
            rows.join(operational, by), "average_precision", "roc_auc", "brier", "log_loss", *_ROUNDED
        )
        if "service_id" not in by:
            both = both.withColumn("service_id", F.lit(None).cast("string"))
        parts.append(both.withColumn("grouping", F.lit(name)))
    return parts[0].unionByName(parts[1])


_BOUNDS = ("average_precision", "incident_detection_rate")


@query(
    "bootstrap_ci",
    f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY partition, candidate ORDER BY run_id) - 1 AS k,
            count(*) OVER (PARTITION BY partition, candidate) AS groups
          FROM (SELECT DISTINCT partition, candidate, run_id FROM predictions)),
        i AS (SELECT partition, candidate, groups, unnest(range(groups)) AS i FROM (SELECT DISTINCT partition,
            candidate, groups FROM g)),
        w AS (SELECT partition, candidate, rep,
            CAST('0x' || substr(md5('2026:' || rep || ':' || i), 1, 8) AS BIGINT) % groups AS k, count(*) AS w
          FROM i CROSS JOIN range(200) AS r(rep) GROUP BY ALL),
        x AS (SELECT partition, candidate, rep, probability, sum(w) AS n, sum(target * w) AS pos
          FROM predictions JOIN g USING (partition, candidate, run_id) JOIN w USING (partition, candidate, k)
          GROUP BY ALL),
        ap AS (SELECT partition, candidate, rep, coalesce(sum(pos * p / n::DOUBLE) / nullif(sum(pos), 0), 0)
            AS average_precision
          FROM (SELECT partition, candidate, rep, pos, sum(pos) OVER o AS p, sum(n) OVER o AS n FROM x
                WINDOW o AS (PARTITION BY partition, candidate, rep ORDER BY probability DESC)) GROUP BY ALL),
        d AS (SELECT partition, candidate, rep, sum(CASE WHEN detected THEN w ELSE 0 END) / sum(w)::DOUBLE
            AS incident_detection_rate
          FROM ({_results(_PLACE, str(THRESHOLD))}) JOIN g USING (partition, candidate, run_id)
          JOIN w USING (partition, candidate, k) GROUP BY ALL)
       SELECT partition, candidate, groups, {", ".join(
           f"CASE WHEN groups >= 2 THEN round(quantile_cont({c}, {q}), 9) END AS {c}_{side}"
           for c in _BOUNDS for side, q in (("low", 0.025), ("high", 0.975)))}
       FROM (SELECT DISTINCT partition, candidate, groups FROM g)
       LEFT JOIN ap USING (partition, candidate) LEFT JOIN d USING (partition, candidate, rep) GROUP BY partition, candidate, groups""",
)
def bootstrap_ci(t):
    events = episodes.incident_results(t.predictions, t.run_incidents, t.grid, GROUP, THRESHOLD)
    found = bootstrap.grouped_uncertainty(t.predictions, events, GROUP, seed=2026, repeats=200)
    return rounded(found, *[f"{c}_{side}" for c in _BOUNDS for side in ("low", "high")])


@query(
    "split_counts",
    """SELECT run_id, partition, count(*) AS rows,
         CAST(sum(incident_within_horizon) AS BIGINT) AS positives,
         min(timestamp) AS first, max(timestamp) AS last FROM modelling_rows GROUP BY ALL""",
)
def split_counts(t):
    return t.rule_rows.groupBy("run_id", "partition").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(TARGET).alias("positives"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
    )


@query(
    "event_counts",
    """SELECT r."group", CASE WHEN r."group" <> 'development' THEN r."group"
              WHEN h < 96 THEN 'train' WHEN h < 144 THEN 'calibration'
              WHEN h < 192 THEN 'validation' ELSE 'temporal_test' END AS onset_partition,
         service_id, incident_type, count(*) AS incidents
       FROM (SELECT *, date_diff('hour', TIMESTAMP '2024-01-01', incident_start) % 240 AS h
             FROM run_incidents) JOIN runs AS r USING (run_id) GROUP BY ALL""",
)
def event_counts(t):
    from telemetry_ops.operators.partitions import onset_partition

    found = onset_partition(t.run_incidents, t.runs, t.grid, STAGES)
    return found.groupBy("group", "onset_partition", "service_id", "incident_type").agg(
        F.count(F.lit(1)).alias("incidents")
    )


