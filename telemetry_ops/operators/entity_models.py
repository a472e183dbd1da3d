"""One logistic model per machine, all machines fitted together.

Every Newton step is one Spark job: tasks add up gradient and curvature terms of the machines they
hold, one packed row per machine and task. These rows are added up as vectors, first over groups of tasks and
then over all, and each machine's small system is solved on its own row. A machine's rows stay spread over
many tasks, so one machine may own most of the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.session import broadcast_if_small, stage

FLUSH_MACHINES = 256
#: Groups of tasks whose sums are added up first.
GROUPS = 64


def class_counts(train: DataFrame, key: str, target: str) -> DataFrame:
    return train.groupBy(key).agg(
        F.count(F.lit(1)).alias("training_rows"),
        F.avg(target).alias("training_prevalence"),
        F.count_if(F.col(target) == 1).alias("_positive"),
        F.count_if(F.col(target) == 0).alias("_negative"),
    )


def _scaling(train: DataFrame, key: str, features: str) -> DataFrame:
    """Mean and population deviation per machine and dimension; constant dimensions divide by 1."""
    per = train.select(key, F.posexplode(features).alias("pos", "x")).groupBy(key, "pos")
    moments = per.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m", "s")))  # one entry per dimension
    return (
        moments.groupBy(key)
        .agg(ordered.alias("_o"))
        .select(
            key,
            F.transform("_o", lambda t: t["m"]).alias("_mean"),
            F.transform("_o", lambda t: F.when(t["s"] > 0, t["s"]).otherwise(1.0)).alias("_std"),
        )
    )


def _standardised(features: str):
    centred = F.zip_with(features, "_mean", lambda x, m: x - m)
    return F.zip_with(centred, "_std", lambda x, s: x / s)


def _terms(key: str):
    """Sums of gradient and curvature terms per machine and task."""

    def add_up(batches):
        sums: dict = {}

        def flush():
            frame = pd.DataFrame(
                {key: list(sums), "terms": [np.concatenate([g, h.ravel()]).tobytes() for g, h in sums.values()]}
            )
            sums.clear()
            return frame

        for batch in batches:
            for machine, part in batch.groupby(key):
                x = np.column_stack([np.stack(part["z"].to_numpy()), np.ones(len(part))])
                w = np.asarray(part["weights"].iloc[0])
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -500, 500)))
                gradient = x.T @ (p - part["y"].to_numpy(float))
                curvature = (x * (p * (1 - p))[:, None]).T @ x
                if machine in sums:
                    sums[machine][0].__iadd__(gradient)
                    sums[machine][1].__iadd__(curvature)
                else:
                    sums[machine] = [gradient, curvature]
            if len(sums) >= FLUSH_MACHINES:
                yield flush()
        if sums:
            yield flush()

    return add_up


def _added(key: str):
    """Sums of packed vectors; rows come in order of the key, so that one sum is held at a time."""

    def add_up(batches):
        current, total = None, None
        for batch in batches:
            done = []
            for machine, packed in zip(batch[key], batch["terms"]):
                part = np.frombuffer(packed)
                if total is not None and machine == current:
                    total = total + part
                    continue
                if total is not None:
                    done.append((current, total.tobytes()))
                current, total = machine, part
            if done:
                yield pd.DataFrame(done, columns=[key, "terms"])
        if total is not None:
            yield pd.DataFrame([(current, total.tobytes())], columns=[key, "terms"])

    return add_up


def _sum_by(partial: DataFrame, key: str) -> DataFrame:
    """One packed vector per key, from one per key and task: by groups of tasks first."""
    schema = ", ".join(f"{n} {k}" for n, k in partial.dtypes)
    grouped = partial.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    grouped = grouped.repartition(key, "_group").sortWithinPartitions(key).drop("_group").mapInPandas(_added(key), schema)
    return grouped.repartition(key).sortWithinPartitions(key).mapInPandas(_added(key), schema)


def _solve(key: str, strength: float):
    """One damped Newton step per machine; the intercept carries no penalty."""

    def step(batches):
        for batch in batches:
            weights, change = [], []
            for w, terms in zip(batch["weights"], batch["terms"]):
                w = np.asarray(w)
                d = len(w)
                penalty = np.r_[np.ones(d - 1), 0.0]
                terms = np.frombuffer(terms)
                gradient = strength * terms[:d] + penalty * w
                curvature = strength * terms[d:].reshape(d, d) + np.diag(penalty + 1e-10)
                move = np.linalg.solve(curvature, gradient)
                size = np.max(np.abs(move))
                move = move / max(1.0, size / 4.0)
                weights.append(w - move)
                change.append(float(size))
            yield pd.DataFrame({key: batch[key], "weights": weights, "change": change})

    return step


def fit_per_entity(
    train: DataFrame,
    key: str,
    features: str,
    target: str,
    *,
    strength: float = 1.0,
    steps: int = 50,
    tolerance: float = 1e-8,
) -> DataFrame:
    """L2 logistic per machine on its own standardised rows: ``key, _mean, _std, weights, converged``.

    Machines whose training rows have one class only are left out. Weights end with the intercept.
    ``converged`` is false where the last step still moved a weight by the tolerance or more.
    """
    usable = class_counts(train, key, target).where("_positive > 0 AND _negative > 0").select(key)
    kept = train.join(usable, key, "left_semi")
    scaling = stage(_scaling(kept, key, features), "entity-scaling")
    machines = scaling.count()
    if not machines:
        return scaling.withColumn("weights", F.array().cast("array<double>")).withColumn("converged", F.lit(False))
    width = scaling.select(F.size("_mean")).first()[0] + 1
    small = broadcast_if_small(scaling, machines, 16 * width)
    rows = stage(
        kept.join(small, key).select(key, _standardised(features).alias("z"), F.col(target).alias("y")),
        "entity-rows",
    )
    weights = scaling.select(key, F.array_repeat(F.lit(0.0), width).alias("weights"))
    kind = dict(train.dtypes)[key]
    for _ in range(steps):
        current = broadcast_if_small(weights, machines, 8 * width)
        partial = rows.join(current, key).mapInPandas(_terms(key), f"{key} {kind}, terms binary")
        summed = _sum_by(partial, key)
        moved = summed.join(weights, key).mapInPandas(
            _solve(key, strength), f"{key} {kind}, weights array<double>, change double"
        )
        moved = stage(moved, "entity-weights")
        weights, state = moved.select(key, "weights"), moved
        if moved.agg(F.max("change")).first()[0] < tolerance:
            break
    return scaling.join(state.select(key, "weights", (F.col("change") < tolerance).alias("converged")), key)


def _probability(z):
    dot = F.aggregate(
        F.zip_with(z, F.slice("weights", 1, F.size("weights") - 1), lambda x, w: x * w),
        F.element_at("weights", -1),
        lambda a, b: a + b,
    )
    return 1.0 / (1.0 + F.exp(-dot))


def score_per_entity(rows: DataFrame, models: DataFrame, key: str, features: str) -> DataFrame:
    """Adds ``probability`` and ``converged``; machines without a model are dropped (see ``class_counts``)."""
    joined = rows.join(models, key)
    return joined.withColumn("probability", _probability(_standardised(features))).drop("_mean", "_std", "weights")


def gradient_at(train: DataFrame, models: DataFrame, key: str, features: str, target: str, strength: float = 1.0) -> DataFrame:
    """``key, training_rows, gradient``: the largest slope of each machine's penalised loss at its weights.

    Computed from the rows and the returned weights alone, so it audits a fit: at the optimum it is 0.
    """
    z = _standardised(features)
    scored = train.join(models, key).select(key, "weights", F.concat(z, F.array(F.lit(1.0))).alias("z"), (_probability(z) - F.col(target)).alias("miss"))
    terms = scored.select(key, "weights", "miss", F.posexplode("z").alias("pos", "x")).groupBy(key, "pos").agg(
        F.sum(F.col("miss") * F.col("x")).alias("slope"), F.first("weights").alias("weights"), F.count(F.lit(1)).alias("training_rows")
    )
    penalty = F.when(F.col("pos") + 1 < F.size("weights"), F.get("weights", F.col("pos"))).otherwise(0.0)
    return terms.groupBy(key).agg(F.first("training_rows").alias("training_rows"), F.max(F.abs(strength * F.col("slope") + penalty)).alias("gradient"))
