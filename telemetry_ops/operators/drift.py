"""Reference distributions, population stability and drift status.

Long frames have ``feature, value``. A reference has one row per feature: strictly increasing
``edges``, the ``expected`` share per bin, and the number of ``samples``. The bin of x is the
number of edges at or below x, plus one if x lies above the largest edge, so values outside the
reference range always have bins of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.ranks import exact_percentiles
from telemetry_ops.operators.quality import count_violations, not_finite

# Statuses from best to worst.
STATUS_ORDER = ("stable", "insufficient", "warning", "severe", "invalid")


@dataclass(frozen=True)
class DriftConfig:
    bins: int = 10
    minimum_samples: int = 100
    smoothing: float = 0.0001
    warning: float = 0.1
    severe: float = 0.25

    def __post_init__(self):
        if not 2 <= self.bins <= 100 or self.minimum_samples < 2:
            raise ValueError("Bins must lie in 2..100 and the minimum of samples be at least 2")
        if not 0 < self.smoothing <= 0.01 or not 0 < self.warning < self.severe:
            raise ValueError("Smoothing must lie in (0, 0.01] and warning be below severe")


def to_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """All feature columns as rows, once."""
    return df.select(*columns).unpivot([], columns, "feature", "value")


def _bin(value: Column, edges: Column, most: int | None = None) -> Column:
    """``most`` is the size that no array of edges exceeds; with it the bin is compiled, without a call for each edge."""
    if most is None:
        below = F.size(F.filter(edges, lambda e: e <= value))
    else:
        below = sum((F.when(F.get(edges, F.lit(i)) <= value, 1).otherwise(0) for i in range(most)), F.lit(0))
    return (below + (value > F.element_at(edges, -1)).cast("int")).cast("bigint")


def drift_reference(long: DataFrame, bins: int) -> DataFrame:
    """Edges at the unique linear-interpolated quantiles 0..1 and the share of rows per bin.

    The query fails on a missing or non-finite value, naming its feature: no reference is built from it.
    """
    bad = F.col("value").isNull() | not_finite(F.col("value"))
    refused = F.raise_error(F.concat(F.lit("Reference value missing or not finite: "), F.col("feature")))
    long = long.withColumn("value", F.when(bad, refused.cast("double")).otherwise(F.col("value")))
    levels = [i / bins for i in range(bins + 1)]
    # How many values lie below each edge is known with the edges, so the values are not read again for the shares.
    found = exact_percentiles(long, ["feature"], "value", levels, few=True)
    found = found.select("feature", "samples", F.array_sort(F.array_distinct(F.arrays_zip("percentiles", "below"))).alias("cuts"))
    total = F.array(F.col("samples"))
    below = F.concat(F.array(F.lit(0).cast("bigint")), F.col("cuts.below"), total, total)
    counts = F.transform(F.sequence(F.lit(1), F.size("cuts") + 2), lambda i: F.get(below, i) - F.get(below, i - 1))
    return found.select(
        "feature", F.col("cuts.percentiles").alias("edges"), F.transform(counts, lambda n: n / F.col("samples")).alias("expected"), "samples"
    )


def invalid_reference_values(long: DataFrame) -> DataFrame:
    """Values a reference must not be built from."""
    return long.where(F.col("value").isNull() | not_finite(F.col("value")))


def status_of(psi: Column, config: DriftConfig) -> Column:
    """Thresholds; equality goes to the higher level."""
    return F.when(psi >= config.severe, "severe").when(psi >= config.warning, "warning").otherwise("stable")


def population_stability(
    long: DataFrame, reference: DataFrame, config: DriftConfig, by: tuple[str, ...] = ()
) -> DataFrame:
    """PSI and status per reference feature; both sides are smoothed and renormalised.

    Non-finite values make a feature ``invalid``; too few samples make it ``insufficient``. Both
    have a null PSI. ``by`` names further keys of ``long``, such as a time interval.
    """
    return stability_of_counts(bin_counts(long, reference, by), reference, config, by)


def bin_counts(long: DataFrame, reference: DataFrame, by: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Rows per feature and bin, non-finite values in bin -1.

    Values are counted map-side, so only bin counts are shuffled. Also works on a stream. ``most`` is the largest
    number of edges of a feature, where it is known.
    """
    value = F.col("value")
    bad = value.isNull() | not_finite(value)
    edges = F.broadcast(reference.select("feature", "edges"))  # one row per feature of the schema
    place = F.when(bad, F.lit(-1).cast("bigint")).otherwise(_bin(value, F.col("edges"), most))
    return (
        long.join(edges, "feature").groupBy(*by, "feature", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )


def stability_of_counts(
    counts: DataFrame, reference: DataFrame, config: DriftConfig, by: tuple[str, ...] = ()
) -> DataFrame:
    """PSI from bin counts; a feature has few bins, so its counts meet in one row."""
    keys = [*by, "feature"]
    found = counts.groupBy(*keys).agg(
        F.sum("n").alias("_n"),
        F.sum(F.when(F.col("bin") < 0, F.col("n")).otherwise(0)).alias("_bad"),
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_counts"),
    )
    if by:
        joined = found.join(F.broadcast(reference.drop("samples")), "feature")
    else:
        joined = reference.drop("samples").join(found, "feature", "left")
    n = F.coalesce("_n", F.lit(0))
    size = F.size("expected").cast("bigint")
    s = F.lit(config.smoothing)
    hits = F.coalesce("_counts", F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<bigint>")))
    shares = F.transform(
        F.sequence(F.lit(0).cast("bigint"), size - 1),
        lambda b: F.coalesce(F.element_at(F.col("_hits"), b), F.lit(0)) / F.greatest(F.col("samples"), F.lit(1)) + s,
    )
    both = joined.select(
        *keys, n.alias("samples"), F.coalesce("_bad", F.lit(0)).alias("_bad"), hits.alias("_hits"), "expected"
    ).select(
        *keys, "samples", "_bad", shares.alias("_a"), F.transform("expected", lambda e: e + s).alias("_e")
    )

    def total(name):
        return F.aggregate(name, F.lit(0.0), lambda x, y: x + y)

    normal = both.withColumn("_sa", total("_a")).withColumn("_se", total("_e"))
    terms = F.zip_with(
        "_a",
        "_e",
        lambda a, e: (a / F.col("_sa") - e / F.col("_se")) * F.ln((a / F.col("_sa")) / (e / F.col("_se"))),
    )
    psi = F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)
    usable = (F.col("_bad") == 0) & (F.col("samples") >= config.minimum_samples)
    return normal.select(*keys, "samples", "_bad", F.when(usable, psi).alias("psi")).select(
        *keys,
        F.when(F.col("_bad") > 0, "invalid")
        .when(F.col("samples") < config.minimum_samples, "insufficient")
        .otherwise(status_of(F.col("psi"), config))
        .alias("status"),
        "samples",
        "psi",
    )


def overall_status(results: DataFrame) -> DataFrame:
    """The worst status of all features."""
    order = F.array(*[F.lit(x) for x in STATUS_ORDER])
    return results.agg(F.max_by("status", F.array_position(order, F.col("status"))).alias("status"))


def training_reference(
    rows: DataFrame, assignments: DataFrame, allowed: DataFrame, keys: list[str], columns: list[str], bins: int
) -> DataFrame:
    """Reference over the rows assigned to ``train`` and nothing else.

    Refuses what ``training_violations`` finds: repeated assignments, training keys without features, and
    training rows outside the ``allowed`` keys.
    """
    found = {r["rule"]: r["rows"] for r in training_violations(rows, assignments, allowed, keys).collect() if r["rows"]}
    if found:
        raise ValueError(f"No reference is built from these training rows: {found}")
    train = assignments.where("partition = 'train'").select(*keys)
    return drift_reference(to_long(rows.join(train, keys, "left_semi"), columns), bins)


def training_violations(
    rows: DataFrame, assignments: DataFrame, allowed: DataFrame, keys: list[str]
) -> DataFrame:
    """``rule, rows`` for duplicated assignments, training keys without features, and training
    rows outside the ``allowed`` keys (held-out runs or beyond the training region)."""
    train = assignments.where("partition = 'train'").select(*keys)
    repeated = assignments.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = {
        "duplicate_assignment": repeated,
        "missing_features": train.join(rows.select(*keys), keys, "left_anti"),
        "outside_training_region": train.join(allowed.select(*keys), keys, "left_anti"),
    }
    result = None
    for name, found in parts.items():
        part = found.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("rule"), "rows")
        result = part if result is None else result.unionByName(part)
    return result


def reference_checks(reference: DataFrame, features: DataFrame) -> DataFrame:
    """``rule, rows`` over the reference: edges, shares, lengths, and the exact inventory."""
    edges, expected = F.col("edges"), F.col("expected")
    steps = F.zip_with(
        F.slice(edges, F.lit(1), F.size(edges) - 1),
        F.slice(edges, F.lit(2), F.size(edges) - 1),
        lambda a, b: b > a,
    )
    total = F.aggregate(expected, F.lit(0.0), lambda a, b: a + b)
    both = features.select("feature", F.lit(True).alias("_want")).join(
        reference.withColumn("_have", F.lit(True)), "feature", "full_outer"
    )
    rules = {
        "missing_feature": F.col("_have").isNull(),
        "unexpected_feature": F.col("_want").isNull(),
        "edges_not_finite": F.exists(edges, not_finite),
        "edges_not_increasing": ~F.forall(steps, lambda up: up),
        "wrong_length": F.size(expected) != F.size(edges) + 2,
        "negative_share": F.exists(expected, lambda e: not_finite(e) | (e < 0)),
        "shares_do_not_sum": F.abs(total - 1) > 1e-8,
    }
    return count_violations(both, rules)
