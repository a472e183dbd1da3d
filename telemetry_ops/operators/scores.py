"""Row scoring: confusion counts, average precision, ROC AUC, Brier, log loss, reliability.

Frames have ``target`` (0/1) and ``probability``; ``by`` names the grouping columns. Curve metrics
work on one row per distinct score, so a group may hold any share of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetry_ops.functions.ranks import cumulative

EPSILON = 2.220446049250313e-16  # fixed value: spacing of doubles at one


def _group(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn("_all_rows", F.lit(1)), ["_all_rows"])


def invalid_predictions(df: DataFrame) -> DataFrame:
    """Rows whose target is not binary or whose probability is not a finite number in [0, 1]."""
    p, y = F.col("probability"), F.col("target")
    return df.where(
        y.isNull() | ~y.isin(0, 1) | p.isNull() | F.isnan(p) | (p < 0) | (p > 1)
    )


def score_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows and positives per distinct score."""
    return df.groupBy(*by, "probability").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("target").cast("bigint").alias("positives")
    )


def precision_recall_curve(df: DataFrame, by: list[str]) -> DataFrame:
    """One point per distinct score, alerts being the rows at or above it."""
    ranked = cumulative(score_counts(df, by), by, "probability", ["rows", "positives"], True)
    return ranked.select(
        *by,
        F.col("probability").alias("threshold"),
        F.col("positives_upto").alias("tp"),
        (F.col("rows_upto") - F.col("positives_upto")).alias("fp"),
        (F.col("positives_upto") / F.col("rows_upto")).alias("precision"),
        F.try_divide(F.col("positives_upto"), F.col("positives_all")).alias("recall"),
    )


def ranking_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Step-weighted average precision (null without positives) and tie-aware ROC AUC (null
    unless both classes occur), from the same ranked scores."""
    ranked = cumulative(score_counts(df, by), by, "probability", ["rows", "positives"], True)
    positives, rows = F.col("positives"), F.col("rows")
    gain = positives / F.col("positives_all") * (F.col("positives_upto") / F.col("rows_upto"))
    negatives_all = F.col("rows_all") - F.col("positives_all")
    below = negatives_all - (F.col("rows_upto") - F.col("positives_upto"))
    # Twice the number of (positive, negative) pairs in the right order, ties counted once.
    pairs = (positives * (2 * below + (rows - positives)).cast("decimal(19,0)")).cast("decimal(38,0)")
    grouped = ranked.groupBy(*by).agg(
        F.max("positives_all").alias("_p"),
        (F.max("rows_all") - F.max("positives_all")).alias("_n"),
        F.sum(F.when(F.col("positives_all") > 0, gain)).alias("_ap"),
        F.sum(pairs).cast("double").alias("_pairs"),
    )
    return grouped.select(
        *by,
        F.when(F.col("_p") > 0, F.col("_ap")).alias("average_precision"),
        F.when(
            (F.col("_p") > 0) & (F.col("_n") > 0),
            F.col("_pairs") / (2.0 * F.col("_p").cast("double") * F.col("_n").cast("double")),
        ).alias("roc_auc"),
    )


def average_precision(df: DataFrame, by: list[str]) -> DataFrame:
    return ranking_metrics(df, by).select(*by, "average_precision")


def roc_auc(df: DataFrame, by: list[str]) -> DataFrame:
    return ranking_metrics(df, by).select(*by, "roc_auc")


def probability_losses() -> list[Column]:
    """Aggregates for the Brier score and the log loss."""
    p, y = F.col("probability"), F.col("target")
    clipped = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return [
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-F.when(y == 1, F.ln(clipped)).otherwise(F.ln(1 - clipped))).alias("log_loss"),
    ]


def brier_log_loss(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*probability_losses())


def confusion(threshold: Column) -> list[Column]:
    alert, positive = F.col("probability") >= threshold, F.col("target") == 1
    return [
        F.count_if(positive & alert).alias("tp"),
        F.count_if(~positive & alert).alias("fp"),
        F.count_if(positive & ~alert).alias("fn"),
        F.count_if(~positive & ~alert).alias("tn"),
    ]


def with_rates(df: DataFrame) -> DataFrame:
    """Adds the ratios of the confusion counts; undefined ratios are null."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        df.withColumn("rows", tp + fp + fn + F.col("tn"))
        .withColumn("positives", tp + fn)
        .withColumn("prevalence", F.try_divide("positives", "rows"))
        .withColumn("precision", F.try_divide(tp, tp + fp))
        .withColumn("recall", F.try_divide(tp, tp + fn))
    )


def confusion_metrics(df: DataFrame, by: list[str], threshold: Column | float = 0.5) -> DataFrame:
    """Counts, prevalence, precision and recall at a threshold (a number or a column)."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return with_rates(df.groupBy(*by).agg(*confusion(threshold)))


def row_metrics(df: DataFrame, by: list[str], threshold: Column | float = 0.5) -> DataFrame:
    """All row metrics per group."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    df, group = _group(df, by)
    counted = with_rates(df.groupBy(*group).agg(*confusion(threshold), *probability_losses()))
    return counted.join(ranking_metrics(df, group), group).drop("_all_rows")


def reliability_table(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Equal right-closed bins of [0, 1], zero in the first; empty bins are kept.

    Limits are ``i / bins``; a score belongs to the first bin whose upper limit reaches it.
    """
    p = F.col("probability")
    uppers = [i / bins for i in range(1, bins + 1)]
    inside = sum(((p > upper).cast("int") for upper in uppers[:-1]), F.lit(0))
    df, group = _group(df, by)
    binned = df.withColumn("bin", inside.cast("bigint"))
    counted = binned.groupBy(*group, "bin").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("target").cast("bigint").alias("positives"),
        F.avg("probability").alias("mean_probability"),
    )
    limits = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("bin"),
                F.lit(i / bins).alias("lower"),
                F.lit((i + 1) / bins).alias("upper"),
            )
            for i in range(bins)
        ]
    )
    table = counted.select(*group).distinct().select(*group, F.inline(limits))
    return (
        table.join(counted, [*group, "bin"], "left")
        .select(
            *group,
            "bin",
            "lower",
            "upper",
            F.coalesce("rows", F.lit(0)).alias("rows"),
            F.coalesce("positives", F.lit(0)).alias("positives"),
            "mean_probability",
            F.try_divide("positives", "rows").alias("observed_fraction"),
        )
        .drop("_all_rows")
    )


def prevalence_score(training: DataFrame, rows: DataFrame) -> DataFrame:
    """Scores rows with the training mean of the target (a one-row aggregate)."""
    prior = training.agg(F.avg("target").alias("probability"))
    return rows.crossJoin(F.broadcast(prior))


def decision(df: DataFrame) -> DataFrame:
    """``probability >= threshold`` as text."""
    return df.withColumn(
        "decision",
        F.when(F.col("probability") >= F.col("threshold"), "elevated-risk").otherwise(
            "not-elevated-risk"
        ),
    )


def stack_candidates(wide: DataFrame, keys: list[str], candidates: list[str]) -> DataFrame:
    """One row per key and candidate, from one score column per candidate."""
    return wide.unpivot(keys, candidates, "candidate", "probability")


def choose_model(table: DataFrame) -> DataFrame:
    """The selected candidate: best raw average precision, then lower log loss, then name.

    Its sigmoid form is taken only if both Brier and log loss are strictly lower. The table has
    one row per candidate.
    """
    family = F.regexp_replace("candidate", "_(raw|sigmoid)$", "")
    rows = table.withColumn("family", family)
    raw = (
        rows.where(F.col("candidate").endswith("_raw"))
        .orderBy(F.desc_nulls_last("average_precision"), F.asc("log_loss"), F.asc("candidate"))
        .limit(1)
    )
    sigmoid = rows.where(F.col("candidate").endswith("_sigmoid")).select(
        "family",
        F.col("candidate").alias("_other"),
        F.col("brier").alias("_brier"),
        F.col("log_loss").alias("_log_loss"),
    )
    better = (F.col("_brier") < F.col("brier")) & (F.col("_log_loss") < F.col("log_loss"))
    return raw.join(sigmoid, "family", "left").select(
        "family", F.when(better, F.col("_other")).otherwise(F.col("candidate")).alias("selected")
    )


def select_threshold(table: DataFrame, by: list[str], max_false_alerts: float) -> DataFrame:
    """Highest detection rate within the false-alert budget, one row per group.

    Ties: fewer alert minutes, then the higher threshold. Undefined rates come last. Groups with
    no feasible threshold are absent; ``require_threshold`` turns that into an error.
    """
    table, group = _group(table, by)
    best = Window.partitionBy(*group).orderBy(
        F.desc_nulls_last("incident_detection_rate"), F.asc("alert_minutes"), F.desc("threshold")
    )
    return (
        table.where(F.col("false_alerts_per_service_day") <= max_false_alerts)
        .withColumn("_rank", F.row_number().over(best))
        .where("_rank = 1")
        .drop("_rank", "_all_rows")
    )


def require_threshold(selected: DataFrame) -> DataFrame:
    if not selected.take(1):
        raise ValueError("Every threshold exceeds the allowed false alerts")
    return selected
