"""Descriptive statistics, slices around incidents, samples and what-if shifts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetry_ops.functions.ranks import exact_percentiles
from telemetry_ops.functions.timeline import running
from telemetry_ops.grid import METRICS, SECOND, TARGET, Grid, floor_div


def label_balance(labels: DataFrame) -> DataFrame:
    """Positive, negative, unknown, incomplete and eligible rows; fractions are null when empty."""
    y = F.col(TARGET)
    eligible = F.col("history_complete") & F.col("horizon_complete")
    counts = labels.agg(
        F.count_if(y == 1).alias("positive"),
        F.count_if(y == 0).alias("negative"),
        F.count_if(y.isNull()).alias("unknown"),
        F.count_if(~F.col("history_complete")).alias("history_incomplete"),
        F.count_if(eligible).alias("eligible_rows"),
        F.count_if(eligible & (y == 1)).alias("_eligible_positive"),
        F.count_if(eligible & y.isNotNull()).alias("_eligible_known"),
    )
    return counts.select(
        "positive",
        "negative",
        "unknown",
        "history_incomplete",
        "eligible_rows",
        F.try_divide("positive", F.col("positive") + F.col("negative")).alias(
            "positive_fraction_observed"
        ),
        F.try_divide("_eligible_positive", "_eligible_known").alias("positive_fraction_eligible"),
    )


def describe_by(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per group and column.

    Columns are turned to rows once; quartiles are exact and never gather a group in one task.
    """
    long = df.select(*by, *columns).unpivot(by, columns, "metric", "value")
    keys = [*by, "metric"]
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_percentiles(long, keys, "value", [0.25, 0.5, 0.75])
    cuts = F.col("percentiles")
    return moments.join(quartiles, keys, "left").select(
        *keys, "count", "mean", "std", "min",
        cuts[0].alias("q25"), cuts[1].alias("q50"), cuts[2].alias("q75"), "max",
    )


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of all pairs, from one aggregate over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in dict.fromkeys([(a, b), (b, a)]):
            cells.append(
                F.struct(F.lit(left).alias("metric"), F.lit(right).alias("other"), F.col(f"`{i}`").alias("r"))
            )
    return wide.select(F.inline(F.array(*cells)))


def counts_by_category(df: DataFrame, column: str, categories: list[str] | DataFrame) -> DataFrame:
    """Rows per category; listed categories without rows count zero."""
    spark = df.sparkSession
    if isinstance(categories, DataFrame):
        table = categories.select(column)
    else:
        names = F.array(*[F.lit(c) for c in categories])
        table = spark.range(1).select(F.explode(names).alias(column))
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    return table.join(counted, column, "left").select(column, F.coalesce("_rows", F.lit(0)).alias("rows"))


def duration_minutes(start: str, end: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / (60.0 * SECOND)


def duration_statistics(incidents: DataFrame) -> DataFrame:
    minutes = duration_minutes("incident_start", "incident_end")
    return incidents.agg(
        F.min(minutes).alias("min_minutes"), F.avg(minutes).alias("mean_minutes"), F.max(minutes).alias("max_minutes")
    )


def normal_segment(telemetry: DataFrame, incidents: DataFrame, grid: Grid, minutes: int = 120) -> DataFrame:
    """Each service's first stretch, capped in length and cut at the first precursor."""
    begin = telemetry.groupBy("service_id").agg(F.min("timestamp").alias("_begin"))
    precursor = incidents.groupBy("service_id").agg(F.min("precursor_start").alias("_precursor"))
    cap = F.timestamp_add("MINUTE", F.lit(minutes).cast("bigint"), F.col("_begin"))
    limits = begin.join(precursor, "service_id", "left").select(
        "service_id", F.least(cap, F.col("_precursor")).alias("_end")
    )
    return (
        telemetry.join(limits, "service_id").where(F.col("timestamp") < F.col("_end")).drop("_end")
    )


def earliest_per_type(incidents: DataFrame) -> DataFrame:
    """The earliest incident of each type (ties: smallest id), by a map-side combined minimum."""
    first = F.min(F.struct("incident_start", "incident_id")).alias("_first")
    return incidents.join(
        incidents.groupBy("incident_type").agg(first),
        "incident_type",
    ).where(
        (F.col("incident_start") == F.col("_first.incident_start"))
        & (F.col("incident_id") == F.col("_first.incident_id"))
    ).drop("_first")


def steps_around(incidents: DataFrame, grid: Grid, margin_steps: int, keep: list[str]) -> DataFrame:
    """Incidents at every grid step of ``[precursor - margin, recovery + margin]``.

    The expansion is as large as the telemetry it selects, and the join on (service, step) that
    follows spreads one long incident over many tasks.
    """
    margin = margin_steps * grid.step_us
    first = -floor_div(-(grid.us("precursor_start") - margin), grid.step_us)
    last = floor_div(grid.us("recovery_end") + margin, grid.step_us)
    return incidents.select(*keep, F.explode(F.sequence(first, last)).alias("_step"))


def around_incidents(telemetry: DataFrame, incidents: DataFrame, grid: Grid, margin_steps: int = 20):
    """Telemetry within the margin around each incident's whole lifecycle."""
    keep = [
        "service_id", "incident_id", "incident_type",
        "precursor_start", "incident_start", "incident_end", "recovery_end",
    ]
    spread = steps_around(incidents, grid, margin_steps, keep)
    rows = telemetry.select("service_id", "timestamp", *METRICS).withColumn("_step", grid.step("timestamp"))
    return rows.join(spread, ["service_id", "_step"]).drop("_step")


def relative_minutes(telemetry: DataFrame, incidents: DataFrame, grid: Grid, margin_steps: int = 20):
    """Window bounds, minutes relative to the onset and minutes since the origin."""
    rows = around_incidents(telemetry, incidents, grid, margin_steps)
    us = grid.us("timestamp")
    return rows.select(
        "incident_id",
        "service_id",
        "timestamp",
        F.timestamp_add("SECOND", F.lit(-grid.window_seconds).cast("bigint"), F.col("timestamp")).alias("window_start"),
        F.col("timestamp").alias("window_end"),
        ((us - grid.us("incident_start")) / (60.0 * SECOND)).alias("minutes_from_onset"),
        (us / (60.0 * SECOND)).alias("elapsed_minutes"),
    )


def phase_means(
    telemetry: DataFrame, incidents: DataFrame, grid: Grid, columns: list[str], margin_steps: int = 20
) -> DataFrame:
    """Mean metrics per incident and lifecycle phase; phases are half-open and empty ones absent."""
    margin = F.lit(margin_steps * grid.step_us)
    rows = around_incidents(telemetry, incidents, grid, margin_steps)
    at = grid.us("timestamp")
    precursor, onset = grid.us("precursor_start"), grid.us("incident_start")
    end, recovery = grid.us("incident_end"), grid.us("recovery_end")
    phase = (
        F.when((at >= precursor - margin) & (at < precursor), "baseline")
        .when((at >= precursor) & (at < onset), "precursor")
        .when((at >= onset) & (at < end), "active")
        .when((at >= end) & (at < recovery), "recovery")
        .when((at >= recovery) & (at < recovery + margin), "post_recovery")
    )
    return (
        rows.withColumn("phase", phase)
        .where(F.col("phase").isNotNull())
        .groupBy("incident_id", "incident_type", "phase")
        .agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in columns])
    )


def histogram(df: DataFrame, key: str, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between each group's extremes; the last bin is closed on the right."""
    limits = df.groupBy(key).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    width = F.col("_high") - F.col("_low")
    position = F.floor((F.col(column) - F.col("_low")) * bins / width)
    index = F.when(width > 0, F.least(position, F.lit(bins - 1))).otherwise(F.lit(0))
    return (
        df.join(limits, key)
        .groupBy(key, index.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def numbered(df: DataFrame, key: str, grid: Grid) -> DataFrame:
    """Adds the zero-based ``_number`` of each row in time order within its key."""
    pieces = df.withColumn("_piece", floor_div(grid.us("timestamp"), grid.chunk_us))
    one = {"_number": ("sum", F.lit(1).cast("bigint"))}
    return running(pieces, [key], ["timestamp"], "_piece", one, False).drop("_piece")


def even_sample(df: DataFrame, key: str, grid: Grid, samples: int) -> DataFrame:
    """``samples`` evenly spaced rows per key, first and last included, positions cut to integers.

    A row is taken when some k gives ``floor(k * (n-1) / (samples-1))`` equal to its number.
    """
    rows = numbered(df, key, grid)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    wanted = (
        sizes.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)).cast("array<bigint>")))
        .select(key, F.call_function("div", F.col("_k") * (n - 1), F.lit(samples - 1)).alias("_number"))
        .distinct()
    )
    return rows.join(wanted, [key, "_number"], "left_semi").drop("_number")


def head(df: DataFrame, key: str, grid: Grid, rows: int) -> DataFrame:
    """The first rows of each key in time order; a few per task are shuffled, not the timeline."""
    return _top(df, key, F.asc("timestamp"), rows)


def tail(df: DataFrame, key: str, grid: Grid, rows: int) -> DataFrame:
    """The last rows of each key in time order."""
    return _top(df, key, F.desc("timestamp"), rows)


def _top(df: DataFrame, key: str, order, rows: int) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_number", number).where(F.col("_number") <= rows).drop("_number")


def first_timestamps(df: DataFrame, count: int) -> DataFrame:
    """Rows at the first distinct timestamps."""
    times = df.select("timestamp").distinct().orderBy("timestamp").limit(count)
    return df.join(times, "timestamp", "left_semi")


def shift_metrics(
    df: DataFrame,
    scale: dict[str, tuple[float, float]] | None = None,
    constants: dict[str, float] | None = None,
    move: timedelta | None = None,
) -> DataFrame:
    """What-if table: ``value * a + b`` per metric, constants, and a shift in time."""
    scale, constants = scale or {}, constants or {}
    columns = []
    for name in df.columns:
        column = F.col(name)
        if name in scale:
            factor, offset = scale[name]
            column = column * F.lit(float(factor)) + F.lit(float(offset))
        if name in constants:
            column = F.lit(float(constants[name]))
        if name == "timestamp" and move is not None:
            column = F.timestamp_add("SECOND", F.lit(int(move.total_seconds())).cast("bigint"), column)
        columns.append(column.alias(name))
    return df.select(columns)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    best = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")
