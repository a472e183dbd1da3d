"""Purged chronological stages and the onsets that fall into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.timeline import CHUNK, OWN, chunk_window, with_halo
from telemetry_ops.grid import SECOND, Grid

PURGED = "purged"


def inside_partition(grid: Grid, us: Column, start_us: Column, end_us: Column) -> Column:
    """``t - W >= start`` and ``t + H < end``: no window or horizon crosses a boundary."""
    return (us - grid.window_us >= start_us) & (us + grid.horizon_us < end_us)


def assign_partitions(
    rows: DataFrame, runs: DataFrame, grid: Grid, stages: list[tuple[str, float, float]]
) -> DataFrame:
    """Adds ``partition``: a stage, the group of a held-out run, or ``purged``.

    ``runs`` has ``run_id, group, start, end`` (half-open coverage). Runs of group ``development``
    are cut at the given fractions of their length; other runs are one partition named after the
    group. Rows of a run that ``runs`` does not list are purged. The stages are a fixed list, so they
    become a CASE expression and need no range join.
    """
    us, start, end = grid.us("timestamp"), F.col("_start"), F.col("_end")
    joined = rows.join(
        runs.select("run_id", "group", grid.us("start").alias("_start"), grid.us("end").alias("_end")),
        "run_id",
        "left",
    )
    stage = F.when(
        (F.col("group") != "development") & inside_partition(grid, us, start, end), F.col("group")
    )
    for name, lower, upper in stages:
        stage = stage.when(
            (F.col("group") == "development")
            & inside_partition(grid, us, *_bounds(start, end, lower, upper)),
            F.lit(name),
        )
    return joined.withColumn("partition", stage.otherwise(PURGED)).drop("group", "_start", "_end")


def _bounds(start: Column, end: Column, lower: float, upper: float) -> tuple[Column, Column]:
    """Stage limits in whole seconds, so that limits and labels agree to the microsecond."""
    def at(fraction):
        seconds = ((end - start) / SECOND * fraction).cast("bigint")
        return start + seconds * SECOND

    return at(lower), at(upper)


def onset_partition(
    incidents: DataFrame, runs: DataFrame, grid: Grid, stages: list[tuple[str, float, float]]
) -> DataFrame:
    """Adds ``onset_partition`` by the half-open interval that holds the onset (no purge).

    Incidents of unlisted runs keep a null group and partition ``purged``.
    """
    us, start, end = grid.us("incident_start"), F.col("_start"), F.col("_end")
    joined = incidents.join(
        runs.select("run_id", "group", grid.us("start").alias("_start"), grid.us("end").alias("_end")),
        "run_id",
        "left",
    )
    found = F.when(F.col("group") != "development", F.col("group"))
    for name, lower, upper in stages:
        low, high = _bounds(start, end, lower, upper)
        found = found.when((us >= low) & (us < high), F.lit(name))
    return joined.withColumn("onset_partition", F.coalesce(found.otherwise(F.col("group")), F.lit(PURGED))).drop("_start", "_end")


def partition_bounds(runs: DataFrame, grid: Grid, stages) -> DataFrame:
    """The boundary table: ``run_id, partition, start_inclusive, end_exclusive``."""
    start, end = grid.us("start"), grid.us("end")
    origin = grid.time(F.lit(0))

    def moment(us):
        return F.timestamp_add("SECOND", F.call_function("div", us, F.lit(SECOND)), origin)

    pieces = [
        F.struct(
            F.lit(name).alias("partition"),
            moment(_bounds(start, end, lower, upper)[0]).alias("start_inclusive"),
            moment(_bounds(start, end, lower, upper)[1]).alias("end_exclusive"),
        )
        for name, lower, upper in stages
    ]
    whole = F.array(
        F.struct(
            F.col("group").alias("partition"),
            moment(start).alias("start_inclusive"),
            moment(end).alias("end_exclusive"),
        )
    )
    chosen = F.when(F.col("group") == "development", F.array(*pieces)).otherwise(whole)
    return runs.select("run_id", F.inline(chosen))


def rolling_mean(
    rows: DataFrame, key: str, ordinal: str, values: list[str], points: int, chunk: int
) -> DataFrame:
    """Adds ``<v>__mean`` over the last ``points`` rows, null until that many exist."""
    frame = chunk_window([key], ordinal).rangeBetween(-(points - 1), 0)
    line = with_halo(rows, ordinal, chunk, before=points - 1)
    full = F.count(F.lit(1)).over(frame) == points
    means = [F.when(full, F.avg(v).over(frame)).alias(f"{v}__mean") for v in values]
    return line.select("*", *means).where(OWN).drop(OWN, CHUNK)


def ordinal_partitions(
    rows: DataFrame,
    key: str,
    ordinal: str,
    window: int,
    horizon: int,
    cuts: list[tuple[str, float, float]],
) -> DataFrame:
    """Adds ``partition`` from fractions of each key's length, purged like time partitions."""
    sizes = rows.groupBy(key).agg((F.max(ordinal) + 1).alias("_rows"))
    at, n = F.col(ordinal), F.col("_rows")
    stage = None
    for name, lower, upper in cuts:
        low = F.floor(n * F.lit(float(lower)))
        high = n if upper >= 1 else F.floor(n * F.lit(float(upper)))
        condition = (at - window >= low) & (at + horizon < high)
        stage = F.when(condition, F.lit(name)) if stage is None else stage.when(condition, F.lit(name))
    return rows.join(sizes, key).withColumn("partition", stage.otherwise(PURGED)).drop("_rows")


