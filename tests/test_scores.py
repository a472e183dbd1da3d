import math
import random

import pytest
from pyspark.sql import functions as F

from telemetry_ops.functions.ranks import exact_percentiles
from telemetry_ops.operators import bootstrap, scores
from tests.helpers import predictions


def _frame(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "target bigint, probability double")


def _one(df):
    return df.collect()[0].asDict()


def _ap(pairs):
    total = sum(y for y, _ in pairs)
    area, tp, n = 0.0, 0, 0
    for score in sorted({p for _, p in pairs}, reverse=True):
        hit = [y for y, p in pairs if p == score]
        tp, n = tp + sum(hit), n + len(hit)
        area += sum(hit) / total * tp / n
    return area


def _auc(pairs):
    up = [p for y, p in pairs if y]
    down = [p for y, p in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))


def test_ranking_metrics_with_ties(spark):
    draw = random.Random(1)
    pairs = [(draw.random() < 0.3, draw.choice([0, 0.1, 0.1000001, 0.5, 0.9, 1])) for _ in range(200)]
    found = _one(scores.row_metrics(_frame(spark, pairs), [], 0.5))
    assert found["average_precision"] == pytest.approx(_ap(pairs))
    assert found["roc_auc"] == pytest.approx(_auc(pairs))
    assert found["tp"] == sum(1 for y, p in pairs if y and p >= 0.5)


def test_one_class_gives_nulls(spark):
    found = _one(scores.row_metrics(_frame(spark, [(0, 0.2), (0, 0.4)]), [], 0.5))
    assert found["average_precision"] is None and found["roc_auc"] is None
    assert found["precision"] is None and found["recall"] is None and found["prevalence"] == 0
    found = _one(scores.row_metrics(_frame(spark, [(1, 0.2), (1, 0.4)]), [], 0.3))
    assert found["average_precision"] == 1 and found["roc_auc"] is None and found["recall"] == 0.5


def test_no_rows_give_no_groups(spark):
    assert scores.row_metrics(_frame(spark, []), []).count() == 0


def test_extreme_probabilities_have_finite_log_loss(spark):
    found = _one(scores.brier_log_loss(_frame(spark, [(0, 1.0), (1, 0.0)]).withColumn("g", F.lit(1)), ["g"]))
    assert found["brier"] == 1 and math.isfinite(found["log_loss"]) and found["log_loss"] > 30


def test_invalid_predictions(spark):
    rows = _frame(spark, [(0, 0.0), (1, 1.0), (2, 0.5), (1, 1.1), (0, float("nan"))])
    assert scores.invalid_predictions(rows).count() == 3


def test_reliability_bins_are_right_closed_and_kept_when_empty(spark):
    table = scores.reliability_table(_frame(spark, [(1, 0.0), (0, 0.1), (1, 0.3), (1, 0.31), (0, 1.0)]), [])
    assert {r["bin"]: r["rows"] for r in table.collect()} == {0: 2, 2: 1, 3: 1, 9: 1, 1: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}


def test_threshold_choice(spark):
    schema = "threshold double, false_alerts_per_service_day double, incident_detection_rate double, alert_minutes double"
    rows = [(0.1, 2.0, 1.0, 9.0), (0.2, 1.0, 0.8, 7.0), (0.3, 0.5, 0.8, 5.0), (0.25, 0.5, 0.8, 5.0), (0.9, 0.0, None, 0.0)]
    table = spark.createDataFrame(rows, schema)
    assert _one(scores.select_threshold(table, [], 1.0))["threshold"] == 0.3
    with pytest.raises(ValueError):
        scores.require_threshold(scores.select_threshold(table, [], -1.0))


@pytest.mark.parametrize("brier, loss, chosen", [(0.1, 0.2, "b_sigmoid"), (0.1, 0.4, "b_raw")])
def test_model_choice(spark, brier, loss, chosen):
    rows = [
        ("a_raw", 0.9, 0.2, 0.5), ("b_raw", 0.9, 0.2, 0.4), ("c_raw", 0.8, 0.1, 0.1),
        ("b_sigmoid", 0.9, brier, loss), ("a_sigmoid", 0.99, 0.0, 0.0),
    ]
    table = spark.createDataFrame(rows, "candidate string, average_precision double, brier double, log_loss double")
    assert _one(scores.choose_model(table))["selected"] == chosen


def test_exact_percentiles_of_any_values(spark):
    import numpy as np

    draw = np.random.default_rng(4)
    groups = {"wide": draw.normal(0, 1e6, 301), "tiny": draw.normal(0, 1e-9, 100), "ties": np.repeat([-2.0, 0, 7], 40), "one": np.array([3.5])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    levels = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    for row in exact_percentiles(df, ["g"], "v", levels).collect():
        assert row["samples"] == len(groups[row["g"]])
        np.testing.assert_allclose(row["percentiles"], np.quantile(groups[row["g"]], levels), rtol=1e-12, atol=1e-18)


def test_bootstrap_equals_resampling_whole_runs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(bootstrap, "BUCKET_SCORES", 5)
    draw = random.Random(6)
    rows = [(f"r{k}", "a", m, draw.choice([0.1, 0.3, 0.3, 0.6, 0.8]) + draw.choice([0, 0.01]), draw.random() < 0.4) for k in range(4) for m in range(30)]
    events = spark.createDataFrame(
        [(f"r{k}", draw.random() < 0.5) for k in range(4) for _ in range(5)], "run_id string, detected boolean"
    )
    kept = [(r["run_id"], r["detected"]) for r in events.collect()]
    df = predictions(spark, rows).withColumn("g", F.lit("x"))
    found = _one(bootstrap.grouped_uncertainty(df, events.withColumn("g", F.lit("x")), ["g"], seed=5, repeats=40))
    aps, rates = [], []
    for r in range(40):
        weights = bootstrap.replicate_weights(5, r, 4)
        pairs = [(y, p) for run, _, _, p, y in rows for _ in range(weights[int(run[1])])]
        aps.append(_ap(pairs))
        hit = [d for run, d in kept for _ in range(weights[int(run[1])])]
        rates.append(sum(hit) / len(hit))
    assert found["groups"] == 4
    for name, values in (("average_precision", aps), ("incident_detection_rate", rates)):
        low, high = np.quantile(values, [0.025, 0.975])
        assert found[f"{name}_low"] == pytest.approx(low) and found[f"{name}_high"] == pytest.approx(high)


def test_bootstrap_needs_two_runs(spark):
    rows = predictions(spark, [("r", "a", m, 0.5, m % 2) for m in range(6)]).withColumn("g", F.lit(1))
    events = spark.createDataFrame([(1, "r", True)], "g int, run_id string, detected boolean")
    found = _one(bootstrap.grouped_uncertainty(rows, events, ["g"], repeats=5))
    assert found["groups"] == 1 and found["average_precision_low"] is None
