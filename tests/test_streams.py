import json
import os
import random
from datetime import UTC, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetry_ops.grid import FEATURES, METRICS, Grid
from telemetry_ops.operators.features import window_features
from telemetry_ops.operators.outcomes import delayed_labels
from telemetry_ops.streaming import jobs
from telemetry_ops.streaming.runner import run_available
from telemetry_ops.streaming.state import DelayedOutcomes, merged_intervals
from tests.helpers import ORIGIN, at


def _record(service, minute, value=1.0, **change):
    stamp = at(minute).isoformat() + "Z"
    return json.dumps({"timestamp": stamp, "service_id": service, **{m: value / 10 for m in METRICS}, **change})


def _ingest(spark, folder):
    records = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(folder / "in"))
    jobs.ingest_stream(
        records, "value", str(folder / "out"), str(folder / "bad"), str(folder / "progress"),
        services=spark.createDataFrame([("a",), ("b",)], "service_id string"),
        now=F.lit(at(100)).cast("timestamp_ntz"), state_partitions=2,
    )
    stored = {(r["service_id"], r["timestamp"]): r["error_rate"] for r in spark.read.parquet(str(folder / "out")).collect()}
    bad = sorted(r["reason"] for r in spark.read.parquet(str(folder / "bad")).collect())
    return stored, bad


def test_ingest_keeps_first_writes_and_accepts_old_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text(
        "\n".join([_record("a", 50), _record("a", 50), _record("z", 50), _record("b", 200), "not json", "[1]"])
    )
    stored, bad = _ingest(spark, tmp_path)
    assert stored == {("a", at(50)): 0.1}
    assert bad == ["future", "not_an_object", "not_an_object", "service"]
    (tmp_path / "in" / "2.txt").write_text("\n".join([_record("a", 50, 2.0), _record("b", 1), _record("a", 50)]))
    stored, bad = _ingest(spark, tmp_path)
    assert stored[("b", at(1))] == 0.1 and stored[("a", at(50))] == 0.1
    assert len(stored) == 2


def test_replayed_batch_adds_nothing(spark, tmp_path):
    from telemetry_ops.streaming.runner import append_new

    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    append_new(rows, str(tmp_path / "t"), ["k"], "v")
    append_new(rows, str(tmp_path / "t"), ["k"], "v")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


# -- stateful processors --------------------------------------------------------------------------


def _stream(spark, folder, batches, schema):
    """One file per batch, read in this order, one at a time."""
    folder.mkdir(exist_ok=True)
    for k, rows in enumerate(batches):
        path = folder / f"{k}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


POINT = "service_id string, timestamp timestamp, " + ", ".join(f"{m} double" for m in METRICS)
SMALL = Grid(ORIGIN, 60, 5 * 60, 10 * 60)


def _point(service, minute, value=1.0):
    return (service, at(minute).replace(tzinfo=UTC), *[None if value is None else float(value + k) for k in range(len(METRICS))])


def _windows(spark, folder, batches, delay="30 minutes", **more):
    features = jobs.sliding_features(
        _stream(spark, folder / "in", batches, POINT), SMALL, delay=delay, coverage_start=F.lit(at(-100).replace(tzinfo=UTC)),
        scales={m: 100 for m in METRICS}, chunk_points=more.get("chunk_points", 7),
    )
    counted = jobs.feature_table(features, str(folder / "out"), str(folder / "progress"), 2)
    return spark.read.parquet(str(folder / "out")), counted


def _sorted(df):
    columns = ["service_id", "timestamp", *FEATURES]
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def _batch_windows(spark, rows):
    telemetry = spark.createDataFrame([r for b in rows for r in b], POINT).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return window_features(telemetry, SMALL, coverage_start=F.lit(at(-100)).cast("timestamp_ntz"), scales={m: 100 for m in METRICS})


@pytest.mark.parametrize("chunk_points", [2, 7])
def test_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path, chunk_points):
    """Points come in any order within the delay, over many chunks, with gaps, repeats, nulls and points off the grid."""
    rng = random.Random(chunk_points)
    rows = [_point(s, m, rng.randrange(100)) for s in ("a", "b") for m in range(60) if rng.random() < 0.93 or m < 8]
    rows += [_point("a", 40.5, 3), _point("b", 200, 3), _point("c", 10, 1), _point("b", 70, None), *[_point("b", 71 + k, k) for k in range(7)]]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rng.randrange(20)))
    batches = [rows[k : k + 60] for k in range(0, len(rows), 60)]
    batches[0].append(_point("a", 2, 50))  # a repeat
    found, counted = _windows(spark, tmp_path, batches, chunk_points=chunk_points, delay="4 hours")
    assert _sorted(found) == _sorted(_batch_windows(spark, batches)) and found.count() > 30
    assert counted["late"] == 0 and counted["rows"] == len(rows) + 1 and counted["batches"] >= len(batches)


def test_late_point_completes_its_window_and_too_late_ones_are_counted(spark, tmp_path):
    first = [_point("a", m, m) for m in range(10) if m != 6]
    late, too_late = [_point("a", 6, 6)], [_point("a", 10, 10)]
    found, counted = _windows(spark, tmp_path, [first, late, [_point("a", 100, 0)], [_point("a", 101, 0)], too_late])
    assert sorted(r["timestamp"] for r in found.collect()) == [at(m) for m in range(4, 10)]
    assert counted["late"] == 2  # once in its own chunk, once as the past of the next


def test_state_is_dropped_behind_the_watermark(spark, tmp_path):
    batches = [[_point("a", 60 * k + m, m) for m in range(10)] for k in range(6)]
    features = jobs.sliding_features(
        _stream(spark, tmp_path / "in", batches, POINT), SMALL, delay="10 minutes", coverage_start=F.lit(at(-100).replace(tzinfo=UTC)), chunk_points=5
    )
    rows = []
    run_available(features, lambda b, _: rows.append(b.count()), str(tmp_path / "progress"), "append", 2)
    state = spark.read.format("statestore").option("stateVarName", "points").load(str(tmp_path / "progress"))
    assert sum(rows) == 36 and state.count() <= 4  # of 18 chunks


def _late_ingest(spark, folder, batches):
    (folder / "in").mkdir(exist_ok=True)
    for k, lines in enumerate(batches):
        path = folder / "in" / f"{k}.txt"
        if not path.exists():
            path.write_text("\n".join(lines))
            os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    names = ("out", "bad", "progress", "late", "counts")
    out, bad, progress, late, counts = (str(folder / n) for n in names)
    records = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(folder / "in"))
    jobs.ingest_stream(
        records, "value", out, bad, progress, services=spark.createDataFrame([("a",), ("b",)], "service_id string"),
        now=F.lit(at(1000)).cast("timestamp_ntz"), late=late, delay="30 minutes", counts=counts, state_partitions=2,
    )
    return [tuple(r) for r in jobs.ingest_counts(spark, counts).orderBy("batch").select("inserted", "unchanged", "rejected", "late").collect()]


def test_every_record_is_counted_and_late_ones_are_kept(spark, tmp_path):
    batches = [
        [_record("a", 100), _record("a", 100), _record("a", 1), "not json", _record("b", 2000)],
        [_record("a", 60), _record("a", 60), _record("a", 71), _record("a", 100), _record("a", 100, 2.0), _record("b", 101), _record("b", 102, error_rate=9)],
        [_record("b", 5), _record("b", 5, 3.0), _record("a", 1)],
    ]
    assert _late_ingest(spark, tmp_path, batches) == [(2, 1, 2, 0), (2, 1 - 1, 3, 2), (0, 0, 0, 3)]
    stored = {(r["service_id"], r["timestamp"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert stored == {("a", at(100)), ("a", at(1)), ("a", at(71)), ("b", at(101))}
    now = F.lit(at(1000)).cast("timestamp_ntz")
    first = jobs.merge_late(spark, str(tmp_path / "out"), str(tmp_path / "late"), now)
    assert first == {"inserted": 1, "unchanged": 1, "duplicate": 2}
    assert jobs.merge_late(spark, str(tmp_path / "out"), str(tmp_path / "late"), now) == {"unchanged": 2, "duplicate": 2}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    with pytest.raises(ValueError, match="late rows"):
        jobs.ingest_stream(None, "value", "", "", "", services=None, now=now, delay="1 day")


def test_merged_intervals():
    rng = random.Random(4)
    for _ in range(100):
        given = [(b, b + rng.randrange(1, 6)) for b in (rng.randrange(40) for _ in range(rng.randrange(0, 9)))]
        begins, ends = merged_intervals(*(np.array([g[k] for g in given], dtype=np.int64) for k in (0, 1)))
        covered = {x for b, e in given for x in range(b, e)}
        assert covered == {x for b, e in zip(begins, ends) for x in range(b, e)}
        assert all(b > e for b, e in zip(begins[1:], ends[:-1]))


def _known(minute):
    return at(minute).replace(tzinfo=UTC)


def _outcomes(spark, folder, predictions, onsets, certificates, cutoff=None, patience=60):
    grid = Grid(ORIGIN, 60, 15 * 60, 10 * 60, chunk_points=30)
    p = _stream(spark, folder / "p", predictions, "id string, service_id string, timestamp timestamp, probability double, produced_at timestamp")
    o = _stream(spark, folder / "o", onsets, "service_id string, start timestamp, recorded_at timestamp")
    c = _stream(spark, folder / "c", certificates, "service_id string, start timestamp, end timestamp, recorded_at timestamp")
    jobs.delayed_stream(
        p, o, c, grid, str(folder / "out"), str(folder / "progress"), delay="5 minutes", patience=timedelta(minutes=patience), cutoff=cutoff, state_partitions=2
    )
    found = spark.read.parquet(str(folder / "out")).where("service_id <> 'end'").collect()
    return {r["id"]: (r["reason"], r["target"]) for r in found}


def test_delayed_stream_equals_batch_at_its_cutoff(spark, tmp_path):
    rng = random.Random(11)
    predictions = [(f"{s}{m}", s, _known(m), 0.5, _known(m + rng.randrange(3))) for s in ("a", "b") for m in range(0, 200, 3)]
    onsets = [(s, _known(m + 0.5 * rng.randrange(2)), _known(m + 2)) for s in ("a", "b") for m in range(5, 200, 37)]
    certificates = [(s, _known(b), _known(b + 20 + rng.randrange(15)), _known(b + 45)) for s in ("a", "b") for b in range(0, 180, 25) if (s, b) != ("a", 75)]
    end = 10_000
    closing = [("end", "end", _known(end), 0.0, _known(end))], [("end", _known(end), _known(end))], [("end", _known(end), _known(end + 1), _known(end))]
    parts = []
    for rows, last, close in ((predictions, 4, closing[0]), (onsets, 2, closing[1]), (certificates, 3, closing[2])):
        rows = sorted(rows, key=lambda r, last=last: r[last])
        parts.append([rows[: len(rows) // 2], rows[len(rows) // 2 :], close])
    got = _outcomes(spark, tmp_path, *parts, cutoff=at(190))
    frames = (
        (predictions, "id string, service_id string, timestamp timestamp, probability double, produced_at timestamp"),
        (onsets, "service_id string, start timestamp, recorded_at timestamp"),
        ([(*c, f"c{k}") for k, c in enumerate(certificates)], "service_id string, start timestamp, end timestamp, recorded_at timestamp, source_id string"),
    )
    batch = []
    for rows, schema in frames:
        df = spark.createDataFrame(rows, schema)
        batch.append(df.select(*[F.col(n).cast("timestamp_ntz").alias(n) if k == "timestamp" else F.col(n) for n, k in df.dtypes]))
    want = delayed_labels(*batch, Grid(ORIGIN, 60, 15 * 60, 10 * 60), at(190)).collect()
    assert got == {r["id"]: (r["reason"], r["target"]) for r in want}
    assert {r for r, _ in got.values()} == {None, "immature", "uncertified", "unavailable_prediction"} and {t for _, t in got.values()} == {None, 0, 1}


def test_predictions_wait_for_certificates_and_patience_ends(spark, tmp_path):
    predictions = [[("early", "a", _known(0), 0.1, _known(0)), ("never", "a", _known(40), 0.1, _known(40))], [("end", "end", _known(300), 0.0, _known(300))]]
    onsets = [[("a", _known(10), _known(12))], [("end", _known(300), _known(300))]]
    certificates = [[("a", _known(0), _known(6), _known(20)), ("a", _known(6), _known(30), _known(40))], [("end", _known(300), _known(301), _known(300))]]
    assert _outcomes(spark, tmp_path, predictions, onsets, certificates) == {"early": (None, 1), "never": ("uncertified", None)}


def test_health_lists_silent_services(spark, tmp_path):
    rows = [("a", _known(m), _known(m + lag)) for m, lag in ((0, 1), (1, 5), (2, 2), (3, 2))]
    batches = [rows[:2], rows[2:], [("a", _known(100), _known(100))], [("a", _known(101), _known(101))]]
    stream = _stream(spark, tmp_path / "in", batches, "service_id string, timestamp timestamp, ingested_at timestamp")
    services = spark.createDataFrame([("a",), ("silent",)], "service_id string")
    jobs.health_stream(stream, services, SMALL, timedelta(minutes=10), str(tmp_path / "out"), str(tmp_path / "progress"), delay="1 minute", state_partitions=2)
    found = {r["service_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    a, b = found["a"], found["silent"]
    assert (a["rows"], a["missing_points"], a["event_freshness_seconds"]) == (4, 6, 420.0)
    assert (a["lag_min_seconds"], a["lag_median_seconds"], a["lag_max_seconds"]) == (60.0, 120.0, 300.0)
    assert (b["rows"], b["missing_points"], b["lag_median_seconds"], b["start"]) == (0, 10, None, at(0))


def test_waiting_predictions_are_labelled_at_the_first_timer():
    class Listed:
        def __init__(self, rows):
            self.rows = rows

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

    class Timed:
        def getCurrentWatermarkInMs(self):
            return 50

        def getExpiryTimeInMs(self):
            return 10

    held = DelayedOutcomes(horizon_us=10, chunk_us=100_000, patience_us=0, cutoff_us=None)
    held.waiting = Listed([("a", 5, 0.5), ("b", 25, 0.5), ("c", 45, 0.5)])
    held.onsets, held.certificates = Listed([(30,)]), Listed([(0, 20, 10_000), (20, 40, 40_000), (40, 60, 60_000)])
    (out,) = held.handleExpiredTimer(("s", 0), Timed(), Timed())
    assert out["id"].tolist() == ["a", "b"] and out["target"].tolist() == [0, 1]  # the third is not known yet
    assert [w[0] for w in held.waiting.rows] == ["c"]
