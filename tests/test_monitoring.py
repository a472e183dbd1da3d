import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from telemetry_ops.operators import drift, outcomes, snapshots, summaries
from telemetry_ops.operators.drift import DriftConfig
from tests.helpers import MINUTES, ORIGIN, TINY, at, telemetry

CONFIG = DriftConfig()


def _long(spark, values, feature="x"):
    return spark.createDataFrame([(feature, float(v)) for v in values], "feature string, value double")


def _psi(spark, reference, values, config=CONFIG):
    (row,) = drift.population_stability(
        _long(spark, values), drift.drift_reference(_long(spark, reference), config.bins), config
    ).collect()
    return row


def test_status_edges(spark):
    rows = spark.createDataFrame([(0.0999,), (0.1,), (0.2499,), (0.25,)], "psi double")
    found = [r[0] for r in rows.select(drift.status_of(F.col("psi"), CONFIG)).collect()]
    assert found == ["stable", "warning", "warning", "severe"]


def test_constant_reference(spark):
    same = _psi(spark, [5] * 100, [5] * 100)
    assert same["status"] == "stable" and same["psi"] == pytest.approx(0)
    for shifted in (4.999, 5.001):
        assert _psi(spark, [5] * 100, [shifted] * 100)["status"] == "severe"


def test_insufficient_invalid_and_absent(spark):
    assert _psi(spark, range(100), range(99))["status"] == "insufficient"
    assert _psi(spark, range(100), range(99))["psi"] is None
    assert _psi(spark, range(100), [*range(99), float("nan")])["status"] == "invalid"
    assert _psi(spark, range(100), [*range(150), float("inf")])["status"] == "invalid"
    empty = _psi(spark, range(100), [])
    assert empty["status"] == "insufficient" and empty["samples"] == 0


def test_psi_matches_plain_computation(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    reference, current = draw.normal(0, 1, 500), draw.normal(0.3, 1.4, 400)
    edges = np.unique(np.quantile(reference, np.linspace(0, 1, 11)))
    edges = np.append(edges, np.nextafter(edges[-1], np.inf))

    def shares(x):
        return np.bincount(np.searchsorted(edges, x, side="right"), minlength=len(edges) + 1) / len(x) + 1e-4

    a, e = shares(current), shares(reference)
    a, e = a / a.sum(), e / e.sum()
    assert _psi(spark, reference, current)["psi"] == pytest.approx(float(np.sum((a - e) * np.log(a / e))))


def test_counts_below_percentiles_give_the_shares(spark):
    """The values are read for the edges only; compiled bins are those of the general form."""
    import numpy as np

    from telemetry_ops.functions.ranks import exact_percentiles

    draw = np.random.default_rng(5)
    values = {"ties": draw.integers(0, 7, 400) / 4, "close": 1 + draw.integers(0, 3, 333) * 2.0**-52, "normal": draw.normal(0, 1, 501), "one": [2.5]}
    long = spark.createDataFrame([(f, float(v)) for f, vs in values.items() for v in vs], "feature string, value double")
    levels = [i / 10 for i in range(11)]
    for few in (False, True):
        for row in exact_percentiles(long, ["feature"], "value", levels, few=few).collect():
            assert row["below"] == [int(np.sum(np.asarray(values[row["feature"]]) < p)) for p in row["percentiles"]]
    reference = drift.drift_reference(long, 10)
    for row in reference.collect():
        edges, x = np.array(row["edges"]), np.asarray(values[row["feature"]], float)
        bins = np.searchsorted(edges, x, "right") + (x > edges[-1])
        assert np.allclose(row["expected"], np.bincount(bins, minlength=len(edges) + 2) / len(x), rtol=0, atol=1e-15)
    other = long.withColumn("value", F.col("value") * 1.5 - 0.5).unionByName(_long(spark, [float("nan"), float("inf")], "normal"))
    assert sorted(drift.bin_counts(other, reference, (), 11).collect()) == sorted(drift.bin_counts(other, reference).collect())


def test_worst_status_wins(spark):
    rows = spark.createDataFrame([("stable",), ("insufficient",), ("warning",)], "status string")
    assert drift.overall_status(rows).first()["status"] == "warning"


def _certificates(spark, spans, service="a"):
    return spark.createDataFrame(
        [(f"c{i}", service, at(s), at(e), at(r)) for i, (s, e, r) in enumerate(spans)],
        "source_id string, service_id string, start timestamp_ntz, end timestamp_ntz, recorded_at timestamp_ntz",
    )


@pytest.mark.parametrize("grid", [MINUTES, TINY])
@pytest.mark.parametrize("spans, covered", [([(0, 5), (5, 10)], True), ([(0, 4), (5, 10)], False), ([(0, 2), (-3, 12)], True)])
def test_union_of_certificates(spark, grid, spans, covered):
    merged = outcomes.merge_coverage(_certificates(spark, [(s, e, 0) for s, e in spans]), grid)
    point = spark.createDataFrame([("a", at(0))], "service_id string, timestamp timestamp_ntz")
    assert outcomes.covered_horizons(point, merged, grid).first()["covered"] is covered


def test_coverage_equals_sequential_cover(spark):
    draw = random.Random(8)
    spans = [(x, x + draw.choice([3, 8, 20, 45])) for x in (draw.randint(0, 200) for _ in range(40))]
    merged = outcomes.merge_coverage(_certificates(spark, [(s, e, 0) for s, e in spans]), TINY)
    points = spark.createDataFrame([("a", at(m)) for m in range(220)], "service_id string, timestamp timestamp_ntz")
    found = {
        int((r["timestamp"] - ORIGIN).total_seconds() // 60): r["covered"]
        for r in outcomes.covered_horizons(points, merged, TINY).collect()
    }
    for m in range(220):
        cursor = m
        for s, e in sorted(spans):
            if s <= cursor:
                cursor = max(cursor, e)
        assert found[m] == (cursor >= m + 10), m


def _delayed(spark, onsets, *, cutoff=60, recorded=50, produced=1):
    rows = spark.createDataFrame(
        [("p", "a", at(20), at(produced), 0.7)],
        "id string, service_id string, timestamp timestamp_ntz, produced_at timestamp_ntz, probability double",
    )
    starts = spark.createDataFrame(
        [(f"i{k}", "a", at(o), at(50)) for k, o in enumerate(onsets)],
        "source_id string, service_id string, start timestamp_ntz, recorded_at timestamp_ntz",
    )
    cover = _certificates(spark, [(0, 100, recorded)])
    return outcomes.delayed_labels(rows, starts, cover, MINUTES, at(cutoff)).first()


@pytest.mark.parametrize("onset, target", [(20, 0), (21, 1), (30, 1), (31, 0)])
def test_delayed_label_boundaries(spark, onset, target):
    row = _delayed(spark, [onset])
    assert row["reason"] is None and row["target"] == target


def test_delayed_exclusions_in_order(spark):
    assert _delayed(spark, [], recorded=61)["reason"] == "uncertified"
    assert _delayed(spark, [], cutoff=29)["reason"] == "immature"
    assert _delayed(spark, [], cutoff=29, produced=30)["reason"] == "unavailable_prediction"
    assert _delayed(spark, [], recorded=61)["target"] is None


def test_import_is_all_or_nothing(spark, tmp_path):
    schema = "source_id string, service_id string, start timestamp_ntz"
    cover_schema = schema + ", end timestamp_ntz"
    stored = spark.createDataFrame([("old", "a", at(1))], schema)
    cover = spark.createDataFrame([("c", "a", at(10), at(20))], cover_schema)
    none = spark.createDataFrame([], cover_schema)
    batch = [("old", "a", at(1)), ("n", "a", at(10)), ("n", "a", at(10)), ("m", "a", at(21))]

    def run(rows):
        return outcomes.import_outcomes(spark.createDataFrame(rows, schema), none, stored, cover, MINUTES, at(99))[0]

    good = run(batch)
    assert {r["status"]: r["records"] for r in outcomes.import_counts(good).collect()} == {"inserted": 2, "unchanged": 2}
    outcomes.append_outcomes(good, str(tmp_path / "starts"), at(99))
    assert spark.read.parquet(str(tmp_path / "starts")).count() == 2
    for extra, status in (
        (("x", "a", at(20)), "contradiction"), (("y", "a", at(100)), "future"), (("old", "a", at(2)), "conflict"),
    ):
        bad = run([("z", "a", at(30)), extra])
        assert [r["status"] for r in outcomes.import_errors(bad).collect()] == [status]
        with pytest.raises(ValueError):
            outcomes.append_outcomes(bad, str(tmp_path / "starts"), at(99))
    assert spark.read.parquet(str(tmp_path / "starts")).count() == 2


def test_snapshot_interval_guard():
    snapshots.check_interval(at(0), at(10), at(10))
    snapshots.check_interval(at(0), at(0) + timedelta(days=400), at(999999))  # long intervals are legal
    for start, end, cutoff in ((at(5), at(5), at(9)), (at(0), at(10), at(9))):
        with pytest.raises(ValueError):
            snapshots.check_interval(start, end, cutoff)


def test_ingest_is_first_write_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    first = telemetry(spark, [("a", 1, 5), ("a", 2, 6)])
    stored = first.where("false")
    assert summaries.append_ingest(summaries.ingest_merge(first, stored, at(9)), path, at(9)) == {"inserted": 2, "unchanged": 0}
    stored = spark.read.parquet(path)
    again = telemetry(spark, [("a", 1, 5), ("b", 1, 5)])
    assert summaries.append_ingest(summaries.ingest_merge(again, stored, at(9)), path, at(9)) == {"inserted": 1, "unchanged": 1}
    for rows in ([("a", 1, 7)], [("a", 10, 7)], [("c", 1, 7), ("c", 1, 7)]):
        with pytest.raises(ValueError):
            merged = summaries.ingest_merge(telemetry(spark, rows), spark.read.parquet(path), at(9))
            summaries.append_ingest(merged, path, at(9))
    assert spark.read.parquet(path).count() == 3
