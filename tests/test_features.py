import random

import pytest

from telemetry_ops.grid import FEATURES, METRICS, TARGET, Grid
from telemetry_ops.operators import features, labels, partitions
from tests.helpers import MINUTES, ORIGIN, TINY, at, by_minute, incidents, telemetry

SCALES = {m: 1000 for m in METRICS}


@pytest.mark.parametrize("grid", [MINUTES, TINY])
@pytest.mark.parametrize("scales", [None, SCALES])
def test_ramp_has_closed_form_statistics(spark, grid, scales):
    rows = telemetry(spark, [("a", m, m) for m in range(1, 16)])
    (found,) = features.window_features(rows, grid, scales=scales).collect()
    assert found["timestamp"] == at(15)
    want = {"current": 15, "mean": 8, "std": (280 / 15) ** 0.5, "min": 1, "max": 15, "change": 14, "slope": 1}
    for name, value in want.items():
        assert found[f"latency_p50_ms__{name}"] == pytest.approx(value)
        assert found[f"error_rate__{name}"] == pytest.approx(value / 1000)
    assert [c for c in found.asDict() if "__" in c] == list(FEATURES)


@pytest.mark.parametrize("gap", [1, 8, 15])
def test_missing_sample_gives_no_row(spark, gap):
    rows = telemetry(spark, [("a", m, m) for m in range(1, 16) if m != gap])
    assert features.window_features(rows, MINUTES).count() == 0


def _random_table(spark, seed=3, missing=0.04):
    draw = random.Random(seed)
    return telemetry(
        spark, [(s, m, round(draw.uniform(0, 90), 2)) for s in "ab" for m in range(90) if draw.random() > missing]
    )


def test_chunks_and_future_do_not_change_features(spark):
    rows = _random_table(spark)
    whole = by_minute(features.window_features(rows, MINUTES, scales=SCALES), *FEATURES)
    cut = by_minute(features.window_features(rows, Grid(ORIGIN, chunk_points=7), scales=SCALES), *FEATURES)
    past = by_minute(
        features.window_features(rows.where(rows.timestamp <= at(50)), MINUTES, scales=SCALES), *FEATURES
    )
    assert whole and whole == cut
    assert past == {k: v for k, v in whole.items() if k[1] <= 50}


def test_one_pass_equals_join_of_features_and_labels(spark):
    rows, truth = _random_table(spark, 5), incidents(spark, [("a", 33.5), ("a", 70), ("b", 41), ("b", 89)])
    for grid in (MINUTES, TINY):
        joined = features.attach_targets(
            features.window_features(rows, grid, scales=SCALES),
            labels.future_labels(rows, truth, grid, coverage_end=at(90)),
        )
        fused = features.labelled_features(rows, truth, grid, coverage_end=at(90), scales=SCALES)
        assert by_minute(fused, *FEATURES, TARGET) == by_minute(joined, *FEATURES, TARGET)
        assert fused.count() > 20


def test_point_in_time_features_respect_arrival(spark):
    from pyspark.sql import functions as F

    rows = _random_table(spark, 9, 0).withColumn(
        "ingested_at", F.when(F.col("timestamp") == F.lit(at(40)).cast("timestamp_ntz"), F.lit(at(80))).otherwise(F.col("timestamp")).cast("timestamp_ntz")
    )
    asked = spark.createDataFrame(
        [("a", at(m), at(c)) for m, c in ((39, 60), (40, 60), (54, 60), (55, 60), (54, 80), (5, 60), (200, 300))],
        "service_id string, timestamp timestamp_ntz, cutoff timestamp_ntz",
    )
    found = {
        ((r["timestamp"] - ORIGIN).seconds // 60, (r["cutoff"] - ORIGIN).seconds // 60): r
        for r in features.point_in_time_features(
            asked, rows, MINUTES, request_key=["service_id", "timestamp", "cutoff"], scales=SCALES
        ).collect()
    }
    missing = {k: r["missing_points"] for k, r in found.items()}
    assert missing == {(39, 60): 0, (40, 60): 1, (54, 60): 1, (55, 60): 0, (54, 80): 0, (5, 60): 9, (200, 300): 15}
    whole = by_minute(features.window_features(rows, MINUTES, scales=SCALES), *FEATURES)
    assert tuple(found[(54, 80)][f] for f in FEATURES) == whole[("a", 54)]
    assert found[(54, 60)]["error_rate__mean"] is None


def test_feature_matrix_is_strict(spark):
    good = features.window_features(_random_table(spark), MINUTES).select(*FEATURES)
    assert features.feature_matrix(good).count() == 0
    with pytest.raises(ValueError):
        features.feature_matrix(good.select(*reversed(FEATURES)))
    with pytest.raises(ValueError):
        features.feature_matrix(good.withColumn(FEATURES[0], good[FEATURES[0]].cast("float")))
    bad = good.withColumn(FEATURES[0], good[FEATURES[0]] * float("inf"))
    assert features.feature_matrix(bad).count() > 0


def test_purged_partitions(spark):
    rows = telemetry(spark, [("a", m, 1) for m in (14, 15, 49, 50, 74, 75, 109, 110)]).selectExpr("'r' AS run_id", "*")
    runs = spark.createDataFrame(
        [("r", "development", at(0), at(120))], "run_id string, group string, start timestamp_ntz, end timestamp_ntz"
    )
    found = partitions.assign_partitions(rows, runs, MINUTES, [("train", 0, 0.5), ("test", 0.5, 1)])
    assert {m: p for (_, m), p in by_minute(found, "partition").items()} == {
        14: "purged", 15: "train", 49: "train", 50: "purged", 74: "purged", 75: "test", 109: "test", 110: "purged",
    }
    bounds = {r["partition"]: (r["start_inclusive"], r["end_exclusive"]) for r in partitions.partition_bounds(
        runs, MINUTES, [("train", 0, 0.5), ("test", 0.5, 1)]).collect()}
    assert bounds == {"train": (at(0), at(60)), "test": (at(60), at(120))}
