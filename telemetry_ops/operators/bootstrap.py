"""Whole-run bootstrap of average precision and detection rate.

Rows are reduced to counts per distinct score and run and shuffled once by score bucket. All
replicates are computed inside the bucket with weighted running sums, so rows are never copied per
replicate. What precedes a bucket enters as one total per replicate.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetry_ops.functions.bounds import bounds_below
from telemetry_ops.functions.session import stage

BUCKET_SCORES = 20_000  # distinct scores per bucket to aim at
BLOCK_CELLS = 4_000_000


def replicate_weights(seed: int, replicate: int, runs: int) -> np.ndarray:
    """How often each run is drawn in one replicate (``runs`` draws with replacement).

    A draw is 32 bits of an MD5 over seed, replicate and number, so that any engine can repeat it.
    """
    texts = (f"{seed}:{replicate}:{i}" for i in range(runs))
    draws = [int(md5(t.encode()).hexdigest()[:8], 16) % runs for t in texts]
    return np.bincount(draws, minlength=runs)


@lru_cache(maxsize=16)
def _weights(seed: int, repeats: int, runs: int) -> np.ndarray:
    return np.stack([replicate_weights(seed, r, runs) for r in range(repeats)])


def grouped_uncertainty(
    predictions: DataFrame, events: DataFrame, by: list[str], seed: int = 2026, repeats: int = 200
) -> DataFrame:
    """2.5% and 97.5% percentiles per group of ``by``; null with fewer than two runs.

    Runs (never minute rows) are drawn with replacement, within the runs of each group. ``events``
    has ``run_id, detected``. Draws are a function of the seed and the replicate only.
    """
    runs = (
        predictions.select(*by, "run_id")
        .distinct()
        .withColumn("_run", F.row_number().over(Window.partitionBy(*by).orderBy("run_id")) - 1)
    )
    sizes = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"))
    numbered = runs.join(sizes, by)

    scores = stage(
        predictions.groupBy(*by, "run_id", "probability").agg(
            F.count(F.lit(1)).alias("n"), F.sum("target").alias("pos")
        ),
        "bootstrap-scores",
    )
    # Bounds from the scores themselves: buckets stay even however scores are spread.
    buckets = max(scores.count() // BUCKET_SCORES, 1)
    levels = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(scores.approxQuantile("probability", levels, 0.25 / buckets))) if levels else []
    counts = scores.join(numbered, [*by, "run_id"]).withColumn(
        "_bucket", bounds_below(F.col("probability"), bounds).cast("bigint")
    )
    # Totals of the higher buckets per run: at most one row per group, run and bucket.
    above = Window.partitionBy(*by, "_run").orderBy(F.desc("_bucket")).rangeBetween(
        Window.unboundedPreceding, -1
    )
    totals = counts.groupBy(*by, "_run", "_bucket").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    # A run without rows in a bucket still has rows above it: lay its totals on all buckets.
    shape = counts.select(*by, "_bucket").distinct().join(numbered.select(*by, "_run", "groups"), by)
    before = (
        shape.join(totals, [*by, "_run", "_bucket"], "left")
        .fillna(0, ["n", "pos"])
        .select(
            *by,
            "_run",
            "groups",
            "_bucket",
            F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n"),
            F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("pos"),
        )
    )

    def areas(key, rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        runs = int(totals["groups"].iloc[0])
        weights = _weights(seed, repeats, runs)
        n0 = weights[:, totals["_run"]] @ totals["n"].to_numpy(float)
        p0 = weights[:, totals["_run"]] @ totals["pos"].to_numpy(float)
        rows = rows.sort_values("probability", ascending=False)
        # One column of sums per distinct score; rows of one score share the curve point.
        edges = np.flatnonzero(np.r_[True, np.diff(rows["probability"].to_numpy()) != 0])
        n, pos = rows["n"].to_numpy(), rows["pos"].to_numpy()
        out, positives = np.zeros(repeats), np.zeros(repeats)
        # A block of replicates at a time bounds the memory of the weight matrix.
        block = max(1, BLOCK_CELLS // max(len(rows), 1))
        for first in range(0, repeats, block):
            part = slice(first, min(first + block, repeats))
            drawn = weights[part][:, rows["_run"].to_numpy()]
            step_n = np.add.reduceat(drawn * n, edges, axis=1)
            step_p = np.add.reduceat(drawn * pos, edges, axis=1)
            cum_n = n0[part, None] + np.cumsum(step_n, axis=1)
            cum_p = p0[part, None] + np.cumsum(step_p, axis=1)
            out[part] = np.sum(step_p * cum_p / np.maximum(cum_n, 1), axis=1)
            positives[part] = step_p.sum(axis=1)
        frame = pd.DataFrame({"replicate": np.arange(repeats), "area": out, "positives": positives})
        for name, value in zip(by, key):
            frame[name] = value
        return frame

    kinds = dict(predictions.dtypes)
    schema = "replicate bigint, area double, positives double, " + ", ".join(
        f"{c} {kinds[c]}" for c in by
    )
    keys = [*by, "_bucket"]
    pieces = (
        counts.select(*keys, "_run", "probability", "n", "pos")
        .groupBy(*keys)
        # Fresh column identities: both sides descend from the same table.
        .cogroup(before.select(*[F.col(c).alias(c) for c in before.columns]).groupBy(*keys))
        .applyInPandas(lambda key, a, b: areas(key, a, b), schema)
    )
    precision = pieces.groupBy(*by, "replicate").agg(
        # A resample without positives scores 0, as it finds nothing; it stays in the interval.
        F.coalesce(F.try_divide(F.sum("area"), F.sum("positives")), F.lit(0.0)).alias("average_precision")
    )

    # Detection rate: incidents per run times weights, again per replicate only at run level.
    per_run = (
        events.groupBy(*by, "run_id")
        .agg(F.count(F.lit(1)).alias("incidents"), F.count_if("detected").alias("detected"))
        .join(numbered, [*by, "run_id"])
    )

    def rates(batches):
        for batch in batches:
            for runs, part in batch.groupby("groups"):
                weights = _weights(seed, repeats, int(runs))[:, part["_run"]]
                frames = [
                    part[by].assign(
                        replicate=r,
                        incidents=weights[r] * part["incidents"].to_numpy(),
                        detected=weights[r] * part["detected"].to_numpy(),
                    )
                    for r in range(repeats)
                ]
                yield pd.concat(frames)

    rate_schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", replicate bigint, incidents bigint, detected bigint"
    detection = (
        per_run.select(*by, "groups", "_run", "incidents", "detected")
        .mapInPandas(rates, rate_schema)
        .groupBy(*by, "replicate")
        .agg(F.try_divide(F.sum("detected"), F.sum("incidents")).alias("incident_detection_rate"))
    )

    def interval(name, level):
        # At most one value per replicate.
        return F.percentile(name, level)

    bounds = (
        precision.join(detection, [*by, "replicate"], "left")
        .groupBy(*by)
        .agg(
            *[
                interval(name, level).alias(f"{name}_{side}")
                for name in ("average_precision", "incident_detection_rate")
                for side, level in (("low", 0.025), ("high", 0.975))
            ]
        )
    )
    enough = F.col("groups") >= 2
    return sizes.join(bounds, by, "left").select(
        *by,
        "groups",
        *[
            F.when(enough, F.col(f"{name}_{side}")).alias(f"{name}_{side}")
            for name in ("average_precision", "incident_detection_rate")
            for side in ("low", "high")
        ],
    )
