"""The experiment flow: choices are frozen on validation rows and held-out rows are scored by the record only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetry_ops.functions.session import new_folder
from telemetry_ops.grid import FEATURES, TARGET
from telemetry_ops.operators import experiment as E
from telemetry_ops.operators import models
from telemetry_ops.operators.drift import training_reference
from telemetry_ops.operators.features import attach_targets
from telemetry_ops.operators.scores import row_metrics
from tests.helpers import MINUTES, at, incidents

KEEP = ["run_id", "service_id", "timestamp", "partition", "target"]


def _rows(spark, partition, seed, n=160):
    """Rows of two services whose first feature tells the target; every eighth row is ahead of an onset."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, len(FEATURES)))
    y = [int((k // 2) % 40 < 10) for k in range(n)]
    x[:, 0] += 2 * np.array(y)
    data = [(partition, "ab"[k % 2], at(k // 2), partition, y[k], *map(float, r)) for k, r in enumerate(x)]
    return spark.createDataFrame(data, "run_id string, service_id string, timestamp timestamp_ntz, partition string, target int, " + ", ".join(f"{f} double" for f in FEATURES))


def _truth(spark, partitions):
    return incidents(spark, [(p, s, m) for p in partitions for s in "ab" for m in (10, 50)])


@pytest.fixture(scope="module")
def flow(spark):
    def stage_rows(name, seed):
        return _rows(spark, name, seed).select(*FEATURES, F.col("target").cast("bigint").alias(TARGET), "partition")

    fitted = models.fit_candidates(stage_rows("train", 1), stage_rows("calibration", 2), rounds=3)
    truth = _truth(spark, ["validation", "temporal_test"]).cache()
    validation = models.score_candidates(fitted, _rows(spark, "validation", 3), KEEP).cache()
    path = new_folder(spark, "selection")
    record = E.freeze_selection(validation, truth, MINUTES, 200.0, path)
    return fitted, truth, validation, path, record


def test_fitted_scores_go_from_selection_to_held_out_figures(spark, flow):
    fitted, truth, validation, path, record = flow
    choices = {r["candidate"]: r for r in record.collect()}
    assert choices.keys() == fitted.keys() and sum(c["selected"] for c in choices.values()) == 1
    best = max((c for c in choices.values() if c["candidate"].endswith("_raw")), key=lambda c: c["average_precision"])
    (selected,) = (c["candidate"] for c in choices.values() if c["selected"])
    assert selected.rsplit("_", 1)[0] == best["candidate"].rsplit("_", 1)[0]
    held = _rows(spark, "temporal_test", 4)
    scored = E.score_held_out(spark, path, held, lambda rows: models.score_candidates(fitted, rows, KEEP)).cache()
    assert scored.count() == 160 * len(fitted)
    assert scored.where("(decision = 'elevated-risk') <> (probability >= threshold)").count() == 0
    found = {r["candidate"]: r for r in E.held_out_metrics(scored, truth, MINUTES).collect()}
    for name, r in found.items():
        assert r["threshold"] == choices[name]["threshold"] and r["selected"] == choices[name]["selected"]
        (want,) = row_metrics(scored.where(F.col("candidate") == name), ["candidate"], r["threshold"]).collect()
        assert (r["tp"], r["fp"], r["average_precision"]) == (want["tp"], want["fp"], want["average_precision"])
    services = E.held_out_services(scored, truth, MINUTES).collect()
    assert {(r["service_id"], r["candidate"]) for r in services} == {("a", selected), ("b", selected)}
    assert sum(r["tp"] for r in services) == found[selected]["tp"]


def test_choices_are_made_once_and_on_validation_rows_only(spark, flow):
    fitted, truth, validation, path, _ = flow
    with pytest.raises(Exception, match="(?i)already exists"):
        E.freeze_selection(validation, truth, MINUTES, 200.0, path)
    with pytest.raises(ValueError, match="temporal_test"):
        E.freeze_selection(validation.withColumn("partition", F.lit("temporal_test")), truth, MINUTES, 200.0, new_folder(spark, "s"))
    with pytest.raises(ValueError, match="exceeds the allowed"):
        E.freeze_selection(validation, truth, MINUTES, -1.0, new_folder(spark, "s"), thresholds=[0.0, 0.5])


def test_held_out_scoring_needs_the_whole_record(spark, flow):
    fitted, _, validation, path, _ = flow
    asked = []

    def score(rows):
        asked.append(1)
        return models.score_candidates(fitted, rows, KEEP)

    held = _rows(spark, "temporal_test", 4, 20)
    with pytest.raises(ValueError, match="Nothing was selected"):
        E.score_held_out(spark, new_folder(spark, "none"), held, score)
    stored = spark.read.parquet(path)
    one = stored.first()["candidate"]
    for damaged in (stored.where(F.col("candidate") != one), stored.withColumn("threshold", F.col("threshold") / 2), stored.unionByName(stored.limit(1))):
        other = new_folder(spark, "damaged")
        damaged.write.parquet(other)
        with pytest.raises(ValueError, match="not what was sealed"):
            E.score_held_out(spark, other, held, score)
    for used in ("train", "validation", None):
        with pytest.raises(ValueError, match="not held out"):
            E.score_held_out(spark, path, held.withColumn("partition", F.lit(used).cast("string")), score)
    assert not asked
    with pytest.raises(Exception, match="Not in the record of choices: new_raw"):
        E.score_held_out(spark, path, held, lambda rows: score(rows).withColumn("candidate", F.lit("new_raw"))).collect()


def test_targets_are_attached_one_to_one_or_not_at_all(spark):
    features = spark.createDataFrame([("a", at(1), 1.0), ("a", at(2), 2.0)], "service_id string, timestamp timestamp_ntz, x double")
    schema = f"service_id string, timestamp timestamp_ntz, history_complete boolean, horizon_complete boolean, {TARGET} bigint"
    labels = [("a", at(1), True, True, 1), ("a", at(2), True, False, None), ("b", at(1), True, True, 0)]
    got = attach_targets(features, spark.createDataFrame(labels, schema)).collect()
    assert [(r["x"], r[TARGET]) for r in got] == [(1.0, 1)] and set(got[0].asDict()) == {"service_id", "timestamp", "x", TARGET}
    with pytest.raises(Exception, match="Feature without a label"):
        attach_targets(features, spark.createDataFrame(labels[:1], schema)).collect()
    with pytest.raises(Exception, match="Repeated key"):
        attach_targets(features, spark.createDataFrame([*labels, labels[0]], schema)).collect()
    with pytest.raises(Exception, match="Repeated key"):
        attach_targets(features.unionByName(features), spark.createDataFrame(labels, schema)).collect()


def test_reference_refuses_what_is_not_training(spark):
    rows = spark.createDataFrame([(k, float(k)) for k in range(20)], "k int, x double")
    assigned = spark.createDataFrame([(k, "train" if k < 10 else "validation") for k in range(20)], "k int, partition string")
    allowed = rows.where("k < 12").select("k")
    (found,) = training_reference(rows, assigned, allowed, ["k"], ["x"], 2).collect()
    assert found["samples"] == 10 and found["edges"] == [0.0, 4.5, 9.0]
    bad = {
        "duplicate_assignment": (rows, assigned.unionByName(assigned.limit(1)), allowed),
        "missing_features": (rows.where("k <> 3"), assigned, allowed),
        "outside_training_region": (rows, assigned, allowed.where("k <> 4")),
    }
    for rule, given in bad.items():
        with pytest.raises(ValueError, match=rule):
            training_reference(*given, ["k"], ["x"], 2)
