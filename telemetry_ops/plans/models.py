"""Queries: fitted models, calibration and the ordinal study."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetry_ops.functions.session import stage
from telemetry_ops.grid import FEATURES, METRICS, TARGET
from telemetry_ops.operators import entity_models, labels, models, ordinal, partitions
from telemetry_ops.plans.registry import query
from telemetry_ops.plans.scoring import _ap, _auc, _losses, rounded
from telemetry_ops.plans.windows import _STARTS, ORDINAL_CUTS, ordinal_rows

KEEP = ["run_id", "service_id", "timestamp", "partition", TARGET]


def _forecast_rows(t):
    """Modelling rows whose target is the mean error rate five hours on, at 0.2 or above.

    The given events are independent draws, so future incidents cannot be learnt from them; a mean
    that shares ten of its fifteen points with the present window can.
    """
    keys = ["run_id", "service_id", "timestamp"]
    later = t.modelling_rows.select(
        "run_id",
        "service_id",
        F.timestamp_add("HOUR", F.lit(-5).cast("bigint"), F.col("timestamp")).alias("timestamp"),
        (F.col("error_rate__mean") >= 0.2).cast("bigint").alias(TARGET),
    )
    return stage(t.modelling_rows.drop(TARGET).join(later, keys), "forecast-rows")


def _fit(rows, family):
    return models.fit_candidates(
        rows.where("partition = 'train'"), rows.where("partition = 'calibration'"), families=(family,)
    )


def _scored(t, family):
    rows = _forecast_rows(t)
    return models.score_candidates(_fit(rows, family), rows.where("partition <> 'purged'"), KEEP)


@query("logistic_score")
def logistic_score(t):
    return _scored(t, "logistic").where("candidate = 'logistic_raw'")


@query("boosting_score")
def boosting_score(t):
    return _scored(t, "boosting").where("candidate = 'boosting_raw'")


@query("calibrate")
def calibrate(t):
    return _scored(t, "logistic").where("candidate = 'logistic_sigmoid'")


_FORECAST = """f AS (SELECT m.partition, CAST(l.error_rate__mean >= 0.2 AS BIGINT) AS y
    FROM modelling_rows AS m JOIN modelling_rows AS l ON l.run_id = m.run_id AND l.service_id = m.service_id
      AND l.timestamp = m.timestamp + INTERVAL 5 HOUR)"""


@query(
    "logistic_optimum",
    f"""WITH {_FORECAST} SELECT 'logistic_raw' AS candidate, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, TRUE AS optimal
        FROM f WHERE partition = 'train'
        UNION ALL SELECT 'logistic_sigmoid', count(*), CAST(sum(y) AS BIGINT), TRUE FROM f WHERE partition = 'calibration'""",
)
def logistic_optimum(t):
    """Weights of the fitted model and of its sigmoid map are optima: slopes recomputed from the rows are below 0.0001."""
    rows = _forecast_rows(t)
    fitted = _fit(rows, "logistic")
    sigmoid = fitted["logistic_sigmoid"]
    raw = models.logistic_gap(rows.where("partition = 'train'"), fitted["logistic_raw"])
    held = fitted["logistic_raw"].score(rows.where("partition = 'calibration'").select(*FEATURES, TARGET))
    parts = (("logistic_raw", raw), ("logistic_sigmoid", models.calibration_gap(held, sigmoid.slope, sigmoid.intercept)))
    found = [df.select(F.lit(n).alias("candidate"), "rows", "positives", (F.col("gap") < 1e-4).alias("optimal")) for n, df in parts]
    return found[0].unionByName(found[1])


# -- ordinal study --------------------------------------------------------------------------------


def _study_rows(t):
    """Ordinal rows with target, partition, current values and trailing means, staged."""
    chunk = t.grid.chunk_points
    rows = stage(ordinal_rows(t), "ordinal-rows")
    found = labels.ordinal_targets(rows, "machine", "ordinal", "label", 10, chunk)
    found = partitions.ordinal_partitions(found, "machine", "ordinal", 15, 10, ORDINAL_CUTS)
    found = partitions.rolling_mean(found, "machine", "ordinal", list(METRICS), 15, chunk)
    starts = labels.run_starts(rows, "machine", "ordinal", "label", chunk).select("machine", "ordinal")
    return stage(found, "study-rows"), stage(starts, "study-starts")


def _entity_rows(t):
    rows, _ = _study_rows(t)
    inputs = F.array(*[F.col(m) for m in METRICS], *[F.col(f"{m}__mean") for m in METRICS])
    return rows.select("machine", "ordinal", "partition", "y", inputs.alias("x"))


@query("per_entity_models")
def per_entity_models(t):
    """Logistic per machine on current values and trailing means, scored on later partitions."""
    rows = _entity_rows(t)
    fitted = entity_models.fit_per_entity(rows.where("partition = 'train'"), "machine", "x", "y")
    later = rows.where("partition IN ('validation', 'evaluation')")
    return entity_models.score_per_entity(later, fitted, "machine", "x").drop("x")


_SCORED = f"""study AS MATERIALIZED (SELECT machine, ordinal, y, latency_p95_ms, CASE
      WHEN ordinal - 15 >= 0 AND ordinal + 10 < floor(n * 0.5::DOUBLE) THEN 'train'
      WHEN ordinal - 15 >= floor(n * 0.5::DOUBLE) AND ordinal + 10 < floor(n * 0.7::DOUBLE) THEN 'validation'
      WHEN ordinal - 15 >= floor(n * 0.7::DOUBLE) AND ordinal + 10 < n THEN 'evaluation'
      ELSE 'purged' END AS partition, start
    FROM (SELECT *, CASE WHEN ordinal + 10 < n THEN coalesce(max(start) OVER (PARTITION BY machine
            ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), 0) END AS y FROM ({_STARTS}))),
  scored AS (SELECT s.machine, s.ordinal, s.partition, s.y AS target, f.family,
      CASE WHEN f.family = 'rule' THEN least(s.latency_p95_ms / 100, 1.0::DOUBLE) ELSE p.prior END AS probability
    FROM study AS s JOIN (SELECT machine, round(avg(y), 9) AS prior FROM study
                          WHERE partition = 'train' GROUP BY machine) AS p USING (machine)
    CROSS JOIN (SELECT unnest(['prevalence', 'rule']) AS family) AS f
    WHERE s.partition IN ('validation', 'evaluation')),
  onsets AS (SELECT machine, ordinal AS onset FROM study WHERE start = 1)"""


def _study_sql(by: str) -> str:
    hit = "probability >= 0.5"
    return f"""WITH {_SCORED},
      c AS (SELECT {by}, count(DISTINCT machine) AS machines, count(*) AS rows,
          CAST(sum(target) AS BIGINT) AS positives, sum(target) / count(*)::DOUBLE AS prevalence,
          count(*) FILTER (target = 1 AND {hit}) AS tp, count(*) FILTER (target = 0 AND {hit}) AS fp,
          count(*) FILTER (target = 1 AND NOT {hit}) AS fn, count(*) FILTER (target = 0 AND NOT {hit}) AS tn
        FROM scored GROUP BY {by}),
      e AS (SELECT {by}, count(*) AS scorable, count(lead) AS detected, round(avg(lead), 6) AS mean_lead FROM (
          SELECT s.partition, s.family, s.machine, o.onset, o.onset - min(s.ordinal) FILTER ({hit}) AS lead
          FROM scored AS s JOIN onsets AS o ON o.machine = s.machine AND s.ordinal < o.onset
            AND s.ordinal >= o.onset - 10 GROUP BY s.partition, s.family, s.machine, o.onset) GROUP BY {by}),
      a AS (SELECT {by}, count(*) AS episodes, count(*) FILTER (NOT warned) AS false_ones FROM (
          SELECT partition, family, machine, bool_or(warned) AS warned FROM (
            SELECT s.*, EXISTS (SELECT 1 FROM onsets AS o WHERE o.machine = s.machine
                AND s.ordinal < o.onset AND s.ordinal >= o.onset - 10) AS warned,
              ordinal - row_number() OVER (PARTITION BY partition, family, machine ORDER BY ordinal) AS island
            FROM scored AS s WHERE {hit}) GROUP BY partition, family, machine, island) GROUP BY {by})
      SELECT {", ".join(f"c.{x.strip()}" for x in by.split(","))}, machines, rows, positives, prevalence,
        average_precision, roc_auc, brier, log_loss, tp / nullif(tp + fp, 0)::DOUBLE AS precision,
        tp / nullif(tp + fn, 0)::DOUBLE AS recall, tp, fp, fn, tn,
        coalesce(scorable, 0) AS scorable_starts, coalesce(detected, 0) AS detected_starts,
        detected / nullif(scorable, 0)::DOUBLE AS start_detection_rate, mean_lead AS mean_lead_steps,
        coalesce(false_ones, 0) AS false_alert_episodes, coalesce(episodes, 0) AS alert_episodes,
        tp + fp AS alert_rows, (tp + fp) / nullif(rows, 0)::DOUBLE AS alert_row_fraction
      FROM c LEFT JOIN ({_ap(by, "scored")}) USING ({by}) LEFT JOIN ({_auc(by, "scored")}) USING ({by})
      LEFT JOIN ({_losses(by, "scored")}) USING ({by}) LEFT JOIN e USING ({by}) LEFT JOIN a USING ({by})"""


@query(
    "per_entity_gradient",
    f"""WITH {_SCORED} SELECT machine, count(*) AS training_rows, 0.0::DOUBLE AS gradient, TRUE AS converged FROM study
        WHERE partition = 'train' GROUP BY machine HAVING min(y) < max(y)""",
)
def per_entity_gradient(t):
    """Every machine's weights are an optimum: the slope of its loss, recomputed from the rows, is 0 to six digits."""
    train = _entity_rows(t).where("partition = 'train'")
    fitted = stage(entity_models.fit_per_entity(train, "machine", "x", "y"), "entity-models")
    found = entity_models.gradient_at(train, fitted, "machine", "x", "y").join(fitted.select("machine", "converged"), "machine")
    return found.withColumn("gradient", F.abs(F.round("gradient", 6)))


def _study_scores(t):
    rows, starts = _study_rows(t)
    prior = rows.where("partition = 'train'").groupBy("machine").agg(F.round(F.avg("y"), 9).alias("_prior"))
    rule = F.least(F.col("latency_p95_ms") / 100, F.lit(1.0))
    families = F.array(
        F.struct(F.lit("prevalence").alias("family"), F.col("_prior").alias("probability")),
        F.struct(F.lit("rule").alias("family"), rule.alias("probability")),
    )
    later = rows.where("partition IN ('validation', 'evaluation')").join(prior, "machine")
    scored = later.select(
        "machine", "ordinal", "partition", F.col("y").alias("target"), F.inline(families)
    )
    return stage(scored, "study-scores"), starts


def _study(t, by):
    scored, starts = _study_scores(t)
    grid = ordinal.step_grid(15, 10, t.grid.chunk_points)
    found = ordinal.step_metrics(scored, starts, grid, by)
    found = rounded(found, "average_precision", "roc_auc", "brier", "log_loss")
    return rounded(found, "mean_lead_steps", digits=6)


@query("step_metrics", _study_sql("partition, family, machine"))
def step_metrics(t):
    return _study(t, ["partition", "family", "machine"])


@query("pooled_metrics", _study_sql("partition, family"))
def pooled_metrics(t):
    return _study(t, ["partition", "family"])


