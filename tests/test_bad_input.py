"""Inputs that the tables lack: nulls, repeated keys, crowded values, unlisted runs, odd origins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from telemetry_ops.functions.bounds import bounds_below
from telemetry_ops.functions.ranks import FINE, _bucket, cumulative, exact_percentiles
from telemetry_ops.grid import Grid
from telemetry_ops.operators import drift, features, partitions, snapshots
from telemetry_ops.sources import datasets
from telemetry_ops.streaming import jobs
from tests.helpers import MINUTES, ORIGIN, at, telemetry


def test_null_metric_is_a_gap(spark):
    rows = telemetry(spark, [("a", m, 1) for m in range(40)])
    hurt = rows.withColumn("cpu_utilisation_pct", F.when(F.col("timestamp") != F.lit(at(20)).cast("timestamp_ntz"), F.col("cpu_utilisation_pct")))
    minutes = {(r["timestamp"] - ORIGIN).total_seconds() / 60 for r in features.window_features(hurt, MINUTES).collect()}
    whole = {(r["timestamp"] - ORIGIN).total_seconds() / 60 for r in features.window_features(rows, MINUTES).collect()}
    assert minutes == whole - set(range(20, 35))


def test_repeated_row_does_not_hide_a_missing_one(spark):
    minutes = [m for m in range(40) if m != 20] + [22]
    found = features.window_features(telemetry(spark, [("a", m, 1) for m in minutes]), MINUTES).collect()
    got = {(r["timestamp"] - ORIGIN).total_seconds() / 60 for r in found}
    assert got == {15.0, 16.0, 17.0, 18.0, 19.0, 37.0, 38.0, 39.0}


def test_point_in_time_refuses_nulls_and_copies(spark):
    rows = [("a", m, 1) for m in range(15)] + [("b", m, 1) for m in range(15)] + [("b", 3, 1)]
    seen = telemetry(spark, rows).withColumn("ingested_at", F.col("timestamp"))
    seen = seen.withColumn("error_rate", F.when((F.col("service_id") == "b") | (F.minute("timestamp") != 5), F.col("error_rate")))
    asked = spark.createDataFrame([("r1", "a", at(14), at(60)), ("r2", "b", at(14), at(60))], "id string, service_id string, timestamp timestamp_ntz, cutoff timestamp_ntz")
    got = {r["id"]: r for r in features.point_in_time_features(asked, seen, MINUTES, request_key=["id"]).collect()}
    assert got["r1"]["missing_points"] == 1 and got["r1"]["cpu_utilisation_pct__mean"] is None
    assert got["r2"]["missing_points"] == 0 and got["r2"]["cpu_utilisation_pct__mean"] is None


@pytest.mark.parametrize("value", (float("inf"), float("nan"), None))
def test_reference_refuses_values(spark, value):
    long = spark.createDataFrame([("f", 1.0), ("f", 2.0), ("g", value)], "feature string, value double")
    with pytest.raises(Exception, match="not finite: g"):
        drift.drift_reference(long, 4).collect()


def test_crowded_values_are_spread_and_ranked(spark):
    rng = random.Random(1)
    values = [0.002 + rng.random() * 1e-7 for _ in range(20_000)] + [-1.5, 0.0, 5e-324, 1e308, -1e-300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    largest = df.groupBy(_bucket(F.col("v"), FINE)).count().agg(F.max("count")).first()[0]
    assert largest < 50
    levels = [0.0, 0.1, 0.5, 0.99, 1.0]
    (row,) = exact_percentiles(df, [], "v", levels).collect()
    ordered = sorted(values)
    for level, got in zip(levels, row["percentiles"]):
        position = (len(ordered) - 1) * level
        low = int(position)
        high = min(low + 1, len(ordered) - 1)
        assert got == pytest.approx(ordered[low] + (ordered[high] - ordered[low]) * (position - low), rel=1e-12, abs=0)
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranks = {r["v"]: r["n_upto"] for r in cumulative(counts, [], "v", ["n"]).collect()}
    assert all(ranks[v] == i + 1 for i, v in enumerate(ordered))


def test_buckets_are_monotone_at_powers_of_two(spark):
    values = sorted(x for e in range(-40, 40) for x in (2.0**e, 2.0**e * (1 - 2**-53), 2.0**e * (1 + 2**-52)))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for bits in (10, FINE):
        got = [r["b"] for r in df.select("i", _bucket(F.col("v"), bits).alias("b")).orderBy("i").collect()]
        assert got == sorted(got)


def test_bounds_below(spark):
    bounds = [1.0, 2.0, 2.5, 7.0, 9.0]
    df = spark.createDataFrame([(float(v),) for v in range(12)], "v double")
    got = {r["v"]: r["k"] for r in df.select("v", bounds_below(F.col("v"), bounds).alias("k")).collect()}
    assert got == {float(v): sum(b < v for b in bounds) for v in range(12)}


def test_unlisted_runs_are_purged(spark):
    runs = spark.createDataFrame([("r", "development", at(0), at(1000))], "run_id string, group string, start timestamp_ntz, end timestamp_ntz")
    rows = spark.createDataFrame([("r", at(100)), ("gone", at(100)), (None, at(100))], "run_id string, timestamp timestamp_ntz")
    got = {r["run_id"]: r["partition"] for r in partitions.assign_partitions(rows, runs, MINUTES, [("train", 0.0, 1.0)]).collect()}
    assert got == {"r": "train", "gone": "purged", None: "purged"}
    incidents = rows.withColumnRenamed("timestamp", "incident_start")
    got = {r["run_id"]: r["onset_partition"] for r in partitions.onset_partition(incidents, runs, MINUTES, [("train", 0.0, 1.0)]).collect()}
    assert got == {"r": "train", "gone": "purged", None: "purged"}


def test_file_numbers_order_rows(spark, tmp_path):
    folder = tmp_path / "m" / "machine=a"
    folder.mkdir(parents=True)
    for number in (99999, 100000, 5):
        (folder / f"part-{number:05d}-x.txt").write_text(f"{number}\n")
    rows = sorted(datasets.read_matrix(spark, str(tmp_path / "m")).collect(), key=lambda r: r["ordinal"])
    assert [r["values"] for r in rows] == [[5.0], [99999.0], [100000.0]]


def test_moments_within_a_second_differ(spark):
    df = spark.createDataFrame([(datetime(2025, 1, 1, 0, 0, 0, 1),), (datetime(2025, 1, 1, 0, 0, 0, 2),)], "t timestamp_ntz")
    assert df.select(snapshots.utc_text("t").alias("x")).distinct().count() == 2


def test_stream_windows_follow_the_origin(spark, tmp_path):
    grid = Grid(ORIGIN + timedelta(seconds=30))
    origin = ORIGIN + timedelta(seconds=30)
    stamps = [origin + timedelta(minutes=m) for m in range(30)] + [origin + timedelta(minutes=20, seconds=10)]
    rows = telemetry(spark, [("a", m, m) for m in range(31)])
    stamped = rows.withColumn("k", F.minute("timestamp")).join(
        spark.createDataFrame(list(enumerate(stamps)), "k int, stamp timestamp"), "k"
    )
    source = str(tmp_path / "in")
    stamped.select("service_id", F.col("stamp").alias("timestamp"), *[c for c in rows.columns if c not in ("service_id", "timestamp")]).write.parquet(source)
    table = spark.read.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    live = jobs.sliding_features(stream, grid, delay="1 day", coverage_start=F.lit(origin).cast("timestamp"))
    path = str(tmp_path / "out")
    jobs.feature_table(live, path, str(tmp_path / "progress"), 2)
    batch = features.window_features(table.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), grid)
    key = lambda r: r["timestamp"]
    got, want = (sorted(d.collect(), key=key) for d in (spark.read.parquet(path), batch))
    assert [key(r) for r in got] == [key(r) for r in want] and len(got) == 15
    for a, b in zip(got, want):
        assert a["error_rate__slope"] == pytest.approx(b["error_rate__slope"]) and a["cpu_utilisation_pct__mean"] == pytest.approx(b["cpu_utilisation_pct__mean"])
