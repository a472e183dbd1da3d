"""History completeness and future-start labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.timeline import CHUNK, OWN, chunk_window, with_halo
from telemetry_ops.grid import TARGET, Grid, moment

ENTITY = ("service_id",)


def _offset(grid: Grid, time) -> Column:
    """Microsecond offset of a column, a column name or a ``datetime``."""
    return grid.us(time if isinstance(time, str) else moment(time))


def _spans_window(grid: Grid, start: Column) -> Column:
    """``t - start >= W`` and t lies on the grid that begins at ``start``."""
    elapsed = F.col("_us") - start
    return (elapsed >= grid.window_us) & (F.pmod(elapsed, F.lit(grid.step_us)) == 0)


def _full_history(grid: Grid, entity, seen: Column) -> Column:
    back = (grid.window_points - 1) * grid.step_us
    frame = chunk_window(list(entity), "_us").rangeBetween(-back, 0)
    return F.sum(seen.cast("int")).over(frame) == grid.window_points


def history_complete(
    telemetry: DataFrame, requests: DataFrame, grid: Grid, *, coverage_start=None, entity=ENTITY
) -> DataFrame:
    """Is every grid point in ``(t-W, t]`` present for the entity? One row per distinct request.

    Requested keys may be absent from telemetry. Off-grid telemetry is ignored, so that a count
    of rows cannot hide a wrong timestamp.
    """
    start = F.lit(0) if coverage_start is None else _offset(grid, coverage_start)
    keys = [*entity, "timestamp"]
    seen = telemetry.select(*keys, F.lit(True).alias("_seen"), F.lit(False).alias("_asked"))
    asked = requests.select(*keys, F.lit(False).alias("_seen"), F.lit(True).alias("_asked"))
    points = (
        seen.unionByName(asked)
        .groupBy(*keys)
        .agg(F.max("_seen").alias("_seen"), F.max("_asked").alias("_asked"))
        .withColumn("_us", grid.us("timestamp"))
        .withColumn("_start", start)
        .withColumn("_on", F.pmod(F.col("_us") - F.col("_start"), F.lit(grid.step_us)) == 0)
        .where("_asked OR _on")
    )
    back = (grid.window_points - 1) * grid.step_us
    return (
        with_halo(points, "_us", grid.chunk_us, before=back)
        .withColumn("_full", _full_history(grid, entity, F.col("_seen") & F.col("_on")))
        .where(F.col(OWN) & F.col("_asked"))
        .select(*keys, (F.col("_full") & _spans_window(grid, F.col("_start"))).alias("history_complete"))
    )


def future_labels(
    telemetry: DataFrame,
    incidents: DataFrame,
    grid: Grid,
    *,
    coverage_start=None,
    coverage_end,
    entity=ENTITY,
) -> DataFrame:
    """Labels per telemetry row: does any onset fall in ``(t, t+H]``?

    Null when ``t + H`` reaches the end of coverage. Onsets may lie off the grid. Telemetry keys
    must be unique. History and label come from one shuffle: telemetry rows and onsets share the
    chunked timeline, and two range frames over it count the past rows and the coming onsets.
    """
    start = F.lit(0) if coverage_start is None else _offset(grid, coverage_start)
    end = _offset(grid, coverage_end)
    rows = telemetry.select(
        *entity,
        "timestamp",
        grid.us("timestamp").alias("_us"),
        start.cast("bigint").alias("_start"),
        end.cast("bigint").alias("_end"),
        F.lit(0).alias("_onset"),
    )
    onsets = incidents.select(
        *entity, grid.us("incident_start").alias("_us"), F.lit(1).alias("_onset")
    )
    back = (grid.window_points - 1) * grid.step_us
    line = with_halo(rows, "_us", grid.chunk_us, before=back).unionByName(
        with_halo(onsets, "_us", grid.chunk_us, after=grid.horizon_us), allowMissingColumns=True
    )
    ahead = chunk_window(list(entity), "_us").rangeBetween(1, grid.horizon_us)
    on_grid = F.pmod(F.col("_us") - F.col("_start"), F.lit(grid.step_us)) == 0
    known = F.col("_us") + grid.horizon_us < F.col("_end")
    return (
        line.withColumn(
            "_full", _full_history(grid, entity, (F.col("_onset") == 0) & on_grid)
        )
        .withColumn("_next", F.max("_onset").over(ahead))
        .where(F.col(OWN) & (F.col("_onset") == 0))
        .select(
            *entity,
            "timestamp",
                (F.col("_full") & _spans_window(grid, F.col("_start"))).alias("history_complete"),
            known.alias("horizon_complete"),
            F.when(known, F.coalesce(F.col("_next"), F.lit(0))).cast("bigint").alias(TARGET),
        )
    )


def starts_ahead(points: DataFrame, onsets: DataFrame, grid: Grid, entity=ENTITY) -> DataFrame:
    """Adds ``starts_ahead`` to any points in time: does an onset fall in ``(t, t+H]``?

    ``onsets`` has the entity columns and ``start``.
    """
    line = with_halo(
        points.withColumn("_us", grid.us("timestamp")).withColumn("_onset", F.lit(0)), "_us", grid.chunk_us
    ).unionByName(
        with_halo(
            onsets.select(*entity, grid.us("start").alias("_us"), F.lit(1).alias("_onset")),
            "_us",
            grid.chunk_us,
            after=grid.horizon_us,
        ),
        allowMissingColumns=True,
    )
    ahead = chunk_window(list(entity), "_us").rangeBetween(1, grid.horizon_us)
    return (
        line.withColumn("starts_ahead", F.coalesce(F.max("_onset").over(ahead), F.lit(0)) == 1)
        .where(F.col(OWN) & (F.col("_onset") == 0))
        .drop("_us", "_onset", OWN, CHUNK)
    )


def outside_coverage(telemetry: DataFrame, grid: Grid, coverage_start, coverage_end) -> DataFrame:
    """Telemetry rows outside the half-open coverage; labels are undefined when there are any."""
    us = grid.us("timestamp")
    return telemetry.where(
        (us < _offset(grid, coverage_start)) | (us >= _offset(grid, coverage_end))
    )


def run_starts(rows: DataFrame, key: str, ordinal: str, label: str, chunk: int) -> DataFrame:
    """Rows whose label is 1 and whose predecessor's is not; a positive first row counts."""
    before = chunk_window([key], ordinal).rangeBetween(-1, -1)
    return (
        with_halo(rows, ordinal, chunk, before=1)
        .withColumn("_previous", F.max(label).over(before))
        .where(OWN)
        .where((F.col(label) == 1) & (F.coalesce("_previous", F.lit(0)) == 0))
        .drop("_previous", OWN, CHUNK)
    )


def ordinal_targets(
    rows: DataFrame, key: str, ordinal: str, label: str, horizon: int, chunk: int
) -> DataFrame:
    """Adds ``y``: does a run start among the next ``horizon`` rows? Null for the last ones.

    Ordinals are dense (0, 1, 2, ...) within each key.
    """
    previous = chunk_window([key], ordinal).rangeBetween(-1, -1)
    ahead = chunk_window([key], ordinal).rangeBetween(1, horizon)
    sizes = rows.groupBy(key).agg((F.max(ordinal) + 1).alias("_rows"))
    starts = (
        with_halo(rows, ordinal, chunk, before=1, after=horizon)
        .withColumn("_previous", F.max(label).over(previous))
        # A copied row at the far edge of a halo may miss its predecessor; own rows never read it
        # because the halo reaches one row further back than the frames do.
        .withColumn(
            "_start", ((F.col(label) == 1) & (F.coalesce("_previous", F.lit(0)) == 0)).cast("int")
        )
        .withColumn("_next", F.max("_start").over(ahead))
        .where(OWN)
        .drop("_previous", "_start", OWN, CHUNK)
    )
    return (
        starts.join(sizes, key)
        .withColumn(
            "y",
            F.when(
                F.col(ordinal) + horizon < F.col("_rows"), F.coalesce("_next", F.lit(0))
            ).cast("bigint"),
        )
        .drop("_rows", "_next")
    )


