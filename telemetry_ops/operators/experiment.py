"""An experiment as one flow: choices are made on validation rows, frozen, and only then applied to held-out rows.

The record of the choices is a write-once table with one row per candidate. Each row is sealed and
knows how many rows there are, so that a changed, added or missing row is found. Held-out rows cannot be scored
without it: the functions below read it before they ask for any score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_ops.functions.session import stage
from telemetry_ops.grid import Grid
from telemetry_ops.operators.episodes import default_thresholds, operational_summary, threshold_sweep
from telemetry_ops.operators.scores import choose_model, row_metrics, select_threshold
from telemetry_ops.operators.snapshots import broken_seals, sealed

# Stages whose rows took part in fitting, calibrating or choosing.
USED = ("train", "calibration", "validation")
SELECTION = "validation"


def _as_decimal(df: DataFrame, digits: int | None) -> DataFrame:
    """Doubles rounded, so that choices do not hang on the order in which rows were added up."""
    if digits is None:
        return df
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" and c != "threshold" else F.col(c) for c, kind in df.dtypes])


def freeze_selection(
    scored: DataFrame,
    incidents: DataFrame,
    grid: Grid,
    max_false_alerts: float,
    path: str,
    *,
    thresholds: list[float] | None = None,
    digits: int | None = 9,
) -> DataFrame:
    """Choose the model and every candidate's threshold on validation rows, and store the choices once.

    ``scored``: ``run_id, service_id, timestamp, partition, target, candidate, probability``. Rows of any other
    partition are refused, as is a candidate none of whose thresholds stays within the budget of false alerts. A record
    that exists is never replaced.
    """
    rows = stage(scored.select("run_id", "service_id", "timestamp", "partition", "target", "candidate", "probability"), "validation-scores")
    other = [r[0] for r in rows.where(~F.col("partition").eqNullSafe(SELECTION)).select("partition").distinct().limit(5).collect()]
    if other:
        raise ValueError(f"Choices are made on validation rows only, found {other}")
    metrics = _as_decimal(row_metrics(rows, ["candidate"]), digits)
    chosen = choose_model(metrics)
    sweep = _as_decimal(threshold_sweep(rows, incidents, grid, ["candidate"], thresholds or default_thresholds()), digits)
    cuts = select_threshold(sweep, ["candidate"], max_false_alerts)
    cuts = cuts.select("candidate", "threshold", "incident_detection_rate", "false_alerts_per_service_day", "alert_minutes")
    # One row per candidate from here on; the literal column lets the one chosen model meet all of them.
    table = metrics.select("candidate", "average_precision", "brier", "log_loss").join(cuts, "candidate", "left")
    table = table.join(F.broadcast(chosen.select(F.col("selected").alias("candidate"), F.lit(True).alias("selected"))), "candidate", "left")
    found = table.select(
        "candidate", F.coalesce("selected", F.lit(False)).alias("selected"), "threshold", F.lit(float(max_false_alerts)).alias("max_false_alerts"),
        *[c for c in table.columns if c not in ("candidate", "selected", "threshold")],
    )
    found = stage(found, "selection")
    facts = found.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("threshold").isNull(), F.col("candidate")))).alias("none")).first()
    if facts["none"]:
        raise ValueError(f"Every threshold exceeds the allowed false alerts: {facts['none']}")
    sealed(found.withColumn("candidates", F.lit(facts["n"]))).write.mode("errorifexists").parquet(path)
    return read_selection(rows.sparkSession, path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """The frozen choices; fails unless all rows are there, unchanged, with one selected candidate."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise ValueError(f"Nothing was selected yet: no record at {path}") from error
        raise
    broken = [r["candidate"] for r in broken_seals(stored).select("candidate").limit(5).collect()]
    facts = stored.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("candidate").alias("names"), F.min("candidates").alias("least"),
        F.max("candidates").alias("most"), F.count_if("selected").alias("selected"),
    ).first()
    if broken or {facts["names"], facts["least"], facts["most"]} != {facts["n"]} or facts["selected"] != 1:
        raise ValueError(f"The record at {path} is not what was sealed: {broken or facts.asDict()}")
    return stored.drop("seal", "candidates")


def score_held_out(spark: SparkSession, path: str, rows: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of held-out rows with each candidate's frozen ``threshold``, ``selected`` and the decision.

    The record is read first; ``score`` turns rows into long scores ``.., candidate, probability``. Rows of a stage that
    took part in the choices are refused, as are candidates that the record does not know.
    """
    record = read_selection(spark, path).select("candidate", "threshold", "selected")
    used = [r[0] for r in rows.where(F.col("partition").isin(*USED) | F.col("partition").isNull()).select("partition").distinct().limit(5).collect()]
    if used:
        raise ValueError(f"Rows of {used} are not held out")
    joined = score(rows).join(F.broadcast(record), "candidate", "left")  # one row per candidate
    unknown = F.raise_error(F.concat(F.lit("Not in the record of choices: "), F.col("candidate"))).cast("double")
    joined = joined.withColumn("threshold", F.when(F.col("threshold").isNull(), unknown).otherwise(F.col("threshold")))
    decision = F.when(F.col("probability") >= F.col("threshold"), "elevated-risk").otherwise("not-elevated-risk")
    return joined.withColumn("decision", decision)


def held_out_metrics(scored: DataFrame, incidents: DataFrame, grid: Grid) -> DataFrame:
    """Row and operational figures per partition and candidate, each at its frozen threshold."""
    by = ["partition", "candidate"]
    rows = stage(scored.select("run_id", "service_id", "timestamp", *by, "target", "probability", "threshold", "selected"), "held-out-scores")
    at = F.col("threshold")
    facts = rows.groupBy(*by).agg(F.first("threshold").alias("threshold"), F.first("selected").alias("selected"))
    return facts.join(row_metrics(rows, by, at), by).join(operational_summary(rows, incidents, grid, by, at), by)


def held_out_services(scored: DataFrame, incidents: DataFrame, grid: Grid) -> DataFrame:
    """The same figures of the selected candidate per partition and service."""
    by = ["partition", "service_id"]
    rows = stage(scored.where("selected").select("run_id", "timestamp", *by, "target", "probability", "threshold", "candidate"), "service-scores")
    at = F.col("threshold")
    facts = rows.groupBy(*by).agg(F.first("threshold").alias("threshold"), F.first("candidate").alias("candidate"))
    return facts.join(row_metrics(rows, by, at), by).join(operational_summary(rows, incidents, grid, by, at), by)
