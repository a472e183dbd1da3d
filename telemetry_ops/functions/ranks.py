"""Cumulative counts and exact percentiles over groups of any size.

Rows are reduced to one per distinct value first, so ties cost nothing. Values are then put into
coarse and fine ordered buckets by binary exponent and leading mantissa bits. Only bucket totals are
summed along a whole group; the rows themselves are ordered inside one fine bucket. A double has 52
mantissa bits, so a group has at most 2^23 coarse buckets, a coarse bucket 2^21 fine ones, and a fine
bucket 2^21 distinct values: no task orders more rows than that, however values lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE, FINE = 10, 31  # leading mantissa bits
_EXPONENTS = 1100  # more than the exponents below zero


def _bucket(value: Column, bits: int) -> Column:
    """Monotone in ``value``: its binary exponent and so many leading bits of its mantissa.

    Where the logarithm misses a power of two by one, the remainder leaves ``[0, 1)`` by as much, so
    the bucket is the same. Never null, so that no null filter is pushed below the counts; the branches of
    ``cumulative`` then share one shuffle of them.
    """
    size = F.abs(value.cast("double"))
    exponent = F.floor(F.log2(size))
    scaled = size / F.pow(F.lit(2.0), exponent.cast("double")) - 1
    width = F.lit(1 << bits).cast("bigint")
    place = (exponent + _EXPONENTS) * width + F.floor(scaled * width.cast("double"))
    found = F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, place).otherwise(-place)
    return F.coalesce(found, F.lit(0).cast("bigint"))


def cumulative(
    counts: DataFrame, keys: list[str], value: str, measures: list[str], descending: bool = False
) -> DataFrame:
    """Adds ``<m>_upto`` (running total, own row included) and ``<m>_all`` for each measure.

    ``counts`` holds one row per (keys, value); ``value`` is a finite double.
    """
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    group = keys or ["_everything"]
    rows = counts if keys else counts.withColumn("_everything", F.lit(1))
    rows = rows.withColumn("_b1", _bucket(F.col(value), COARSE)).withColumn(
        "_b2", _bucket(F.col(value), FINE)
    )
    preceding = (Window.unboundedPreceding, -1)
    fine = rows.groupBy(*group, "_b1", "_b2").agg(*[F.sum(m).alias(m) for m in measures])
    coarse = fine.groupBy(*group, "_b1").agg(*[F.sum(m).alias(m) for m in measures])
    over_group = Window.partitionBy(*group)
    over_coarse = Window.partitionBy(*group, "_b1").orderBy(order("_b2")).rowsBetween(*preceding)
    coarse = coarse.select(
        *group,
        "_b1",
        *[
            F.coalesce(
                F.sum(m).over(over_group.orderBy(order("_b1")).rowsBetween(*preceding)), F.lit(0)
            ).alias(f"_{m}_1")
            for m in measures
        ],
        *[F.sum(m).over(over_group).alias(f"{m}_all") for m in measures],
    )
    fine = fine.select(
        *group,
        "_b1",
        "_b2",
        *[F.coalesce(F.sum(m).over(over_coarse), F.lit(0)).alias(f"_{m}_2") for m in measures],
    )
    start = fine.join(coarse, [*group, "_b1"]).select(
        *group,
        "_b2",
        *[(F.col(f"_{m}_1") + F.col(f"_{m}_2")).alias(f"_{m}_before") for m in measures],
        *[f"{m}_all" for m in measures],
    )
    inside = Window.partitionBy(*group, "_b2").orderBy(order(value))
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.drop("_b1")
    for m in measures:
        rows = rows.withColumn(f"_{m}_in", F.sum(m).over(inside))
    out = rows.join(start, [*group, "_b2"])
    for m in measures:
        out = out.withColumn(f"{m}_upto", F.col(f"_{m}_before") + F.col(f"_{m}_in"))
    out = out.drop("_b2", *[f"_{m}_{p}" for m in measures for p in ("in", "before")])
    return out if keys else out.drop("_everything")


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, levels: list[float], weight: str | None = None, few: bool = False
) -> DataFrame:
    """Linear-interpolated percentiles of each group as ``percentiles`` (array) and ``samples``, and how many values lie
    ``below`` each percentile (array).

    Null and NaN values are left out. No task ever holds a whole group. ``few`` tells that there are as few groups as
    feature columns: the wanted buckets are then broadcast, and rows of other buckets need no shuffle.
    """
    number = F.lit(1) if weight is None else F.col(weight)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *keys, F.col(value).cast("double").alias("_v"), number.alias("_w")
    )
    rows = rows.withColumn("_b", _bucket(F.col("_v"), COARSE))
    # Only buckets that hold a wanted rank matter; they are found from totals per bucket, which are summed
    # before the shuffle. Rows of other buckets are never shuffled or ordered.
    group = keys or ["_everything"]
    totals = rows.groupBy(*keys, "_b").agg(F.sum("_w").cast("bigint").alias("_n"))
    totals = totals if keys else totals.withColumn("_everything", F.lit(1))
    along = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(along.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*keys, "_b", "_n", before.alias("_before"), F.sum("_n").over(along).alias("_n_all"))
    wanted = F.lit(False)
    for level in levels:
        position = (F.col("_n_all") - 1) * F.lit(float(level))
        for rank in (F.floor(position), F.ceil(position)):
            wanted = wanted | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")))
    holding = totals.where(wanted).select(*keys, "_b", "_before", "_n_all")
    counts = (
        rows.join(F.broadcast(holding) if few else holding, [*keys, "_b"])
        .groupBy(*keys, "_b", "_v")
        .agg(F.sum("_w").cast("bigint").alias("_n"), F.first("_before").alias("_before"), F.first("_n_all").alias("_total"))
    )
    ranked = cumulative(counts, [*keys, "_b"], "_v", ["_n"]).drop("_n_all")
    ranked = ranked.withColumn("_n_upto", F.col("_n_upto") + F.col("_before")).withColumnRenamed("_total", "_n_all")
    low, high = F.col("_n_upto") - F.col("_n"), F.col("_n_upto")

    def at(rank, what=F.col("_v")):
        return F.max(F.when((low <= rank) & (rank < high), what))

    positions = [(F.col("_n_all") - 1) * F.lit(float(level)) for level in levels]
    touched = F.lit(False)
    for position in positions:
        for rank in (F.floor(position), F.ceil(position)):
            touched = touched | ((low <= rank) & (rank < high))
    picked = ranked.where(touched)
    aggregates = [F.max("_n_all").alias("samples")]
    for i, position in enumerate(positions):
        aggregates += [at(F.floor(position)).alias(f"_lo{i}"), at(F.ceil(position)).alias(f"_hi{i}")]
        aggregates += [at(F.floor(position), low).alias(f"_under{i}"), at(F.floor(position), high).alias(f"_upto{i}")]
        aggregates += [at(F.ceil(position), low).alias(f"_next{i}")]
    grouped = picked.groupBy(*keys).agg(*aggregates)
    values, below = [], []
    for i, level in enumerate(levels):
        position = (F.col("samples") - 1) * F.lit(float(level))
        part = position - F.floor(position)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        values.append(lo + (hi - lo) * part)
        # No value lies between the two; rounding may put the percentile on either.
        below.append(F.when(values[-1] <= lo, F.col(f"_under{i}")).when(values[-1] < hi, F.col(f"_upto{i}")).otherwise(F.col(f"_next{i}")))
    return grouped.select(*keys, "samples", F.array(*values).alias("percentiles"), F.array(*below).alias("below"))


def percentiles_of_counts(value: str, levels: list[float], count: str) -> Column:
    """Percentiles inside ``agg`` for values already reduced to one row per distinct value.

    The buffer grows with the number of distinct values, so use it only where that is bounded
    (fixed-point ratios, whole minutes); otherwise use ``exact_percentiles``.
    """
    return F.percentile(F.col(value), [float(x) for x in levels], F.col(count))
