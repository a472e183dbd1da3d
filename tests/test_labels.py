import random

import pytest

from telemetry_ops.grid import TARGET, Grid
from telemetry_ops.operators import labels
from tests.helpers import MINUTES, ORIGIN, TINY, at, by_minute, incidents, telemetry


@pytest.mark.parametrize("grid", [MINUTES, TINY])
def test_onset_boundaries_and_censoring(spark, grid):
    rows = telemetry(spark, [("a", m, 1) for m in (9, 10, 19, 20, 29, 30, 31)])
    found = labels.future_labels(
        rows, incidents(spark, [("a", 20), ("b", 25)]), grid, coverage_end=at(40)
    )
    assert by_minute(found, "horizon_complete", TARGET) == {
        ("a", 9): (True, 0),
        ("a", 10): (True, 1),
        ("a", 19): (True, 1),
        ("a", 20): (True, 0),
        ("a", 29): (True, 0),
        ("a", 30): (False, None),
        ("a", 31): (False, None),
    }


def test_onsets_between_grid_points(spark):
    grid = Grid(ORIGIN, step_seconds=30)
    rows = telemetry(spark, [("a", 0, 1), ("a", 0.5, 1)])
    found = labels.future_labels(
        rows, incidents(spark, [("a", 10.25), ("a", 10 + 1 / 3)]), grid, coverage_end=at(60)
    )
    assert by_minute(found, TARGET) == {("a", 0): 0, ("a", 0.5): 1}


@pytest.mark.parametrize("grid", [MINUTES, TINY])
def test_history_needs_every_point_of_the_same_service(spark, grid):
    full = [("a", m, 1) for m in range(30)]
    other = [("b", m, 1) for m in range(30) if m != 12]
    asked = telemetry(spark, [(s, m, 1) for s in "ab" for m in (14, 15, 20, 26, 27, 29)] + [("a", 45, 1)])
    found = by_minute(labels.history_complete(telemetry(spark, full + other), asked, grid), "history_complete")
    assert found[("a", 14)] is False and found[("a", 15)] is True and found[("a", 29)] is True
    assert found[("b", 20)] is False and found[("b", 26)] is False and found[("b", 27)] is True
    assert found[("a", 45)] is False


def test_off_grid_rows_cannot_stand_in_for_missing_points(spark):
    rows = [("a", m, 1) for m in range(20) if m != 10] + [("a", 10.5, 1)]
    found = labels.history_complete(telemetry(spark, rows), telemetry(spark, [("a", 18, 1), ("a", 10.5, 1)]), MINUTES)
    assert by_minute(found, "history_complete") == {("a", 18): False, ("a", 10.5): False}


def test_chunks_do_not_change_labels(spark):
    draw = random.Random(7)
    rows = telemetry(spark, [(s, m, 1) for s in "abc" for m in range(120) if draw.random() > 0.03])
    truth = incidents(spark, [(s, draw.uniform(0, 120)) for s in "abc" for _ in range(4)])
    results = [
        by_minute(
            labels.future_labels(rows, truth, Grid(ORIGIN, chunk_points=c), coverage_end=at(120)),
            "history_complete", "horizon_complete", TARGET,
        )
        for c in (1, 5, 1000)
    ]
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("chunk", [3, 1000])
def test_run_starts_and_ordinal_targets(spark, chunk):
    flags = [1 if 20 <= i <= 23 or i == 50 else 0 for i in range(100)]
    rows = spark.createDataFrame([("m", i, f) for i, f in enumerate(flags)], "machine string, ordinal bigint, label bigint")
    starts = labels.run_starts(rows, "machine", "ordinal", "label", chunk)
    assert sorted(r["ordinal"] for r in starts.collect()) == [20, 50]
    found = {r["ordinal"]: r["y"] for r in labels.ordinal_targets(rows, "machine", "ordinal", "label", 10, chunk).collect()}
    assert [i for i in range(100) if found[i] == 1] == [*range(10, 20), *range(40, 50)]
    assert [i for i in range(100) if found[i] is None] == list(range(90, 100))


def test_positive_first_row_starts_a_run(spark):
    rows = spark.createDataFrame([("m", 0, 1), ("m", 1, 1), ("m", 2, 0)], "machine string, ordinal bigint, label bigint")
    assert [r["ordinal"] for r in labels.run_starts(rows, "machine", "ordinal", "label", 10).collect()] == [0]
