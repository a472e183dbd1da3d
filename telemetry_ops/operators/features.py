"""Trailing-window statistics, point-in-time features and the target join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetry_ops.functions.timeline import CHUNK, OWN, chunk_window, with_halo
from telemetry_ops.grid import FEATURES, METRICS, STATISTICS, TARGET, Grid, floor_div
from telemetry_ops.operators.labels import ENTITY, _offset


def _statistics(
    metric: str,
    points: int,
    scale: int | None,
    newest: Column,
    oldest: Column,
    twice_centred: Column,
    over=lambda c: c,
) -> list[Column]:
    """The seven statistics of one metric over a full window, in feature order.

    ``twice_centred`` is the sum of value times twice its offset from the window's middle. With a
    ``scale`` values are fixed-point bigints and every sum is exact, so that results do not depend
    on the order of rows; there is one division at the end.
    """
    value = F.col(metric)
    k = 1.0 if scale is None else float(scale)
    spread = points * (points * points - 1) / 6.0  # twice the sum of squared offsets
    if scale is None:
        mean, std = over(F.avg(value)), over(F.stddev_pop(value))
    else:
        total, squares = over(F.sum(value)), over(F.sum(value * value))
        mean = total / (points * k)
        std = F.sqrt((points * squares - total * total).cast("double")) / (points * k)
    found = {
        "current": newest / k,
        "mean": mean,
        "std": std,
        "min": over(F.min(value)) / k,
        "max": over(F.max(value)) / k,
        "change": (newest - oldest) / k,
        "slope": twice_centred / (spread * k),
    }
    return [found[name].alias(f"{metric}__{name}") for name in STATISTICS]


def _fixed_point(scales: dict[str, int], metrics=METRICS) -> list[Column]:
    return [
        F.round(F.col(m) * scales[m]).cast("bigint").alias(m) if m in scales else F.col(m)
        for m in metrics
    ]


def window_features(
    telemetry: DataFrame,
    grid: Grid,
    *,
    coverage_start=None,
    entity=ENTITY,
    scales: dict[str, int] | None = None,
    metrics: tuple[str, ...] = METRICS,
) -> DataFrame:
    """Seven statistics per metric (49 in all) over ``(t-W, t]``.

    A window with a gap gives no row and is never filled. All frames are ranges over time inside
    chunks and share one Window operator. ``scales`` (metric -> fixed-point factor) makes the sums
    exact; ``points`` squared times the largest scaled value squared must fit a bigint. A null metric
    or a repeated key inside a window counts as a gap.
    """
    rows = _elapsed_rows(telemetry, grid, coverage_start, None, entity, scales or {}, metrics)
    line = with_halo(rows, "_at", grid.chunk_us, before=(grid.window_points - 1) * grid.step_us)
    columns, full = _window_columns(grid, entity, scales or {}, metrics)
    return (
        line.select(*entity, "timestamp", (F.col(OWN) & full).alias("_keep"), *columns)
        .where("_keep")
        .drop("_keep")
    )


def labelled_features(
    telemetry: DataFrame,
    incidents: DataFrame,
    grid: Grid,
    *,
    coverage_start=None,
    coverage_end,
    entity=ENTITY,
    scales: dict[str, int] | None = None,
    metrics: tuple[str, ...] = METRICS,
) -> DataFrame:
    """Eligible feature rows with their target, in one shuffle of the telemetry.

    Gives what ``attach_targets(window_features(...), future_labels(...))`` gives. Telemetry and
    onsets share one chunked timeline: backward frames build the features, a forward frame looks
    for onsets, and no key join is needed.
    """
    rows = _elapsed_rows(telemetry, grid, coverage_start, coverage_end, entity, scales or {}, metrics)
    onsets = incidents.select(*entity, grid.us("incident_start").alias("_at"), F.lit(1).alias("_onset"))
    line = with_halo(
        rows.withColumn("_onset", F.lit(0)),
        "_at",
        grid.chunk_us,
        before=(grid.window_points - 1) * grid.step_us,
    ).unionByName(
        with_halo(onsets, "_at", grid.chunk_us, after=grid.horizon_us), allowMissingColumns=True
    )
    ahead = chunk_window(list(entity), "_at").rangeBetween(1, grid.horizon_us)
    columns, full = _window_columns(grid, entity, scales or {}, metrics)
    known = F.col("_at") + grid.horizon_us < F.col("_end")
    target = F.coalesce(F.max("_onset").over(ahead), F.lit(0)).cast("bigint")
    keep = F.col(OWN) & (F.col("_onset") == 0) & known & full
    return (
        line.select(*entity, "timestamp", keep.alias("_keep"), *columns, target.alias(TARGET))
        .where("_keep")
        .drop("_keep")
    )


def _elapsed_rows(telemetry, grid, coverage_start, coverage_end, entity, scales, metrics):
    """On-grid telemetry with its offset from the origin and from the start of coverage."""
    start = F.lit(0) if coverage_start is None else _offset(grid, coverage_start)
    end = [] if coverage_end is None else [_offset(grid, coverage_end).alias("_end")]
    at = grid.us("timestamp")
    return telemetry.select(
        *entity,
        "timestamp",
        at.alias("_at"),
        (at - start).cast("bigint").alias("_elapsed"),
        *end,
        *_fixed_point(scales, metrics),
    ).where(F.pmod("_elapsed", F.lit(grid.step_us)) == 0)


def _window_columns(grid, entity, scales, metrics) -> tuple[list[Column], Column]:
    """Statistics and the completeness test over backward frames of a chunked timeline.

    Rows of other kinds may lie on the same timeline; their metrics are null, and every aggregate
    skips nulls.
    """
    points = grid.window_points
    frame = chunk_window(list(entity), "_at").rangeBetween(-(points - 1) * grid.step_us, 0)

    def over(column):
        return column.over(frame)

    # Positions count from the start of the chunk, which keeps moments small. Coverage starts on
    # the grid's own points shifted by less than a step at most, so the division is exact there.
    shift = F.pmod(F.col("_at") - F.col("_elapsed"), F.lit(grid.step_us))
    position = floor_div(F.col("_at") - shift, grid.step_us) - F.col(CHUNK) * grid.chunk_points
    columns = []
    for metric in metrics:
        value = F.col(metric)
        total, moments = over(F.sum(value)), over(F.sum(position * value))
        centred = 2 * moments - (2 * position - (points - 1)) * total
        oldest = over(F.first(value, ignorenulls=True))
        columns += _statistics(metric, points, scales.get(metric), value, oldest, centred, over)
    whole = F.col("_elapsed").isNotNull()
    for metric in metrics:
        whole = whole & F.col(metric).isNotNull()
    # As many rows as points, each with all its metrics, and every point hit: a repeated row cannot hide a
    # missing one.
    full = (over(F.count("_elapsed")) == points) & (over(F.count(F.when(whole, 1))) == points)
    for hit in _points_hit(position, points):
        full = full & (over(F.bit_or(hit[0])) == hit[1])
    return columns, full & (F.col("_elapsed") >= grid.window_us)


def _points_hit(position: Column, points: int) -> list[tuple[Column, int]]:
    """Bits of the window's points by position, in words of 60, and what each word is when all are hit."""
    slot = F.pmod(position, F.lit(points))
    words = []
    for first in range(0, points, 60):
        size = min(60, points - first)
        inside = slot.between(first, first + size - 1)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot - first).cast("int"))
        words.append((F.when(inside, bit), (1 << size) - 1))
    return words


def point_in_time_features(
    requests: DataFrame,
    telemetry: DataFrame,
    grid: Grid,
    *,
    request_key: list[str],
    scales: dict[str, int] | None = None,
) -> DataFrame:
    """Features for (service_id, timestamp) requests from rows that had arrived by ``cutoff``.

    Every request comes back with ``missing_points``; its features are null unless the whole
    window had arrived. Requests and telemetry meet on a time bucket of one window, so a request
    reads at most two buckets of its own service.
    """
    scales = scales or {}
    points, width = grid.window_points, grid.window_us
    asked = requests.withColumn("_at", grid.us("timestamp"))
    oldest = F.col("_at") - (points - 1) * grid.step_us
    spread = asked.withColumn(
        "_bucket",
        F.explode(F.sequence(floor_div(oldest, width), floor_div(F.col("_at"), width))),
    )
    seen = telemetry.select(
        "service_id",
        grid.us("timestamp").alias("_us"),
        F.col("ingested_at").alias("_arrived"),
        *_fixed_point(scales),
    ).withColumn("_bucket", floor_div(F.col("_us"), width))
    behind = F.col("_at") - F.col("_us")
    in_window = (
        (behind >= 0)
        & (behind < width)
        & (F.pmod(behind, F.lit(grid.step_us)) == 0)
        & (F.col("_arrived") <= F.col("cutoff"))
    )
    pairs = (
        spread.join(seen, ["service_id", "_bucket"])
        .where(in_window)
        .withColumn("_back", floor_div(behind, grid.step_us))
    )
    aggregates = []
    for metric in METRICS:
        value = F.col(metric)
        newest = F.max(F.when(F.col("_back") == 0, value))
        first = F.max(F.when(F.col("_back") == points - 1, value))
        centred = F.sum((points - 1 - 2 * F.col("_back")) * value)
        aggregates += _statistics(metric, points, scales.get(metric), newest, first, centred)
    whole = F.lit(True)
    for metric in METRICS:
        whole = whole & F.col(metric).isNotNull()
    # A window has few points, so the set of those found is small.
    built = pairs.groupBy(*request_key).agg(
        F.size(F.collect_set(F.when(whole, F.col("_back")))).cast("bigint").alias("_found"),
        F.count(F.lit(1)).alias("_rows"),
        *aggregates,
    )
    joined = requests.join(built, request_key, "left")
    found = F.coalesce("_found", F.lit(0).cast("bigint"))
    return joined.select(
        *requests.columns,
        (points - found).alias("missing_points"),
        *[F.when((found == points) & (F.col("_rows") == points), F.col(f)).alias(f) for f in FEATURES],
    )


def attach_targets(features: DataFrame, labels: DataFrame, keys=("service_id", "timestamp")):
    """One-to-one key join that keeps rows with full history, full horizon and a known target.

    The query fails on a feature key without a label and on a key that either side holds more than once;
    ``unmatched_features`` and ``duplicate_keys`` list them. Counting keys needs no shuffle beyond that of the join.
    """
    keys = list(keys)
    copies = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    known = labels.withColumn("_labels", copies)
    asked = features.withColumn("_features", copies)
    refused = (
        F.when(F.col("_labels").isNull(), F.raise_error(F.concat(F.lit("Feature without a label: "), F.to_json(F.struct(*keys)))).cast("boolean"))
        .when((F.col("_labels") > 1) | (F.col("_features") > 1), F.raise_error(F.concat(F.lit("Repeated key: "), F.to_json(F.struct(*keys)))).cast("boolean"))
    )
    eligible = F.col("history_complete") & F.col("horizon_complete") & F.col(TARGET).isNotNull()
    joined = asked.join(known, keys, "left").where(refused.otherwise(eligible))
    return joined.drop("history_complete", "horizon_complete", "_labels", "_features")


def unmatched_features(features: DataFrame, labels: DataFrame, keys=("service_id", "timestamp")):
    """Feature keys without a label."""
    return features.select(*keys).join(labels.select(*keys), list(keys), "left_anti")


def feature_matrix(df: DataFrame) -> DataFrame:
    """Strict inference boundary: exact names, order and type; returns the non-finite rows."""
    if tuple(df.columns) != FEATURES:
        raise ValueError("Expected exactly the feature columns, in the order of the contract")
    wrong = [field.name for field in df.schema if field.dataType.simpleString() != "double"]
    if wrong:
        raise ValueError(f"Features must be doubles: {wrong}")
    return df.where(not_finite_row())


def not_finite_row() -> Column:
    """Whether a feature of the row is missing or not finite."""
    bad = F.lit(False)
    for name in FEATURES:
        column = F.col(name)
        bad = bad | column.isNull() | F.isnan(column) | (F.abs(column) == float("inf"))
    return bad
