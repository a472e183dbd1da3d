"""Windows over long timelines, split into time chunks.

A handful of services may own most rows, so ``partitionBy(service)`` would leave most tasks idle
and a few overloaded. Each timeline is cut into chunks of fixed length; rows that a neighbouring
chunk needs are copied into it, and every row is kept only by the chunk that owns it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetry_ops.grid import floor_div

CHUNK, OWN = "_chunk", "_own"


def with_halo(df: DataFrame, position: str, chunk: int, before: int = 0, after: int = 0) -> DataFrame:
    """Copy each row to every chunk whose windows may read it.

    ``before``/``after``: how far back/ahead of a row its windows look, in units of ``position``.
    """
    at = F.col(position)
    first, last = floor_div(at - after, chunk), floor_div(at + before, chunk)
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(
        OWN, F.col(CHUNK) == floor_div(at, chunk)
    )


def chunk_window(keys: list[str], position: str):
    return Window.partitionBy(*keys, CHUNK).orderBy(position)


def contiguous_runs(
    rows: DataFrame,
    keys: list[str],
    step: str,
    chunk: int,
    extremes: dict[str, Column] | None = None,
) -> DataFrame:
    """Maximal runs of consecutive steps per key: ``start_step, end_step, length``.

    ``extremes`` names columns whose maximum over the run is reported as well. Runs are found
    inside chunks; only runs that touch a chunk edge (two per chunk at most) are merged in a
    second pass over each timeline. Keys and step together must be unique.
    """
    extremes = extremes or {}
    in_chunk = Window.partitionBy(*keys, CHUNK).orderBy(step)
    local = (
        rows.withColumn(CHUNK, floor_div(F.col(step), chunk))
        .withColumn("_island", F.col(step) - F.row_number().over(in_chunk))
        .groupBy(*keys, CHUNK, "_island")
        .agg(
            F.min(step).alias("start_step"),
            F.max(step).alias("end_step"),
            F.count(F.lit(1)).alias("length"),
            *[F.max(column).alias(name) for name, column in extremes.items()],
        )
    )
    names = [*keys, "start_step", "end_step", "length", *extremes]
    opens = F.pmod(F.col("start_step"), F.lit(chunk)) == 0
    closes = F.pmod(F.col("end_step"), F.lit(chunk)) == chunk - 1
    along = Window.partitionBy(*keys).orderBy("start_step")
    merged = (
        local.where(opens | closes)
        .withColumn(
            "_break",
            F.coalesce((F.col("start_step") != F.lag("end_step").over(along) + 1).cast("int"), F.lit(1)),
        )
        .withColumn("_run", F.sum("_break").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(
            F.min("start_step").alias("start_step"),
            F.max("end_step").alias("end_step"),
            F.sum("length").alias("length"),
            *[F.max(name).alias(name) for name in extremes],
        )
    )
    return local.where(~(opens | closes)).select(names).unionByName(merged.select(names))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: str,
    measures: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` along a timeline of any length.

    ``bucket`` cuts the timeline into ordered pieces. Pieces are summarised first, the running
    value of the summaries is carried into each piece, and rows are ordered inside their piece
    only. With ``inclusive=False`` the row itself is left out.
    """
    combine = {"sum": F.sum, "max": F.max, "min": F.min}
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    along = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(*keys, bucket).agg(
        *[combine[how](column).alias(f"_{name}_piece") for name, (how, column) in measures.items()]
    )
    for name, (how, _) in measures.items():
        carried = carried.withColumn(f"_{name}_carry", combine[how](f"_{name}_piece").over(along))
    carried = carried.drop(*[f"_{name}_piece" for name in measures])
    local = df
    for name, (how, column) in measures.items():
        local = local.withColumn(f"_{name}_local", combine[how](column).over(inside))
    joined = local.join(carried, [*keys, bucket])
    for name, (how, _) in measures.items():
        a, b = F.col(f"_{name}_carry"), F.col(f"_{name}_local")
        if how == "sum":
            value = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        else:
            value = (F.greatest if how == "max" else F.least)(a, b)
        joined = joined.withColumn(name, value)
    return joined.drop(*[f"_{n}_{part}" for n in measures for part in ("carry", "local")])
