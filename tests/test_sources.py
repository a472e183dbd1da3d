import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from telemetry_ops.grid import METRICS, TARGET
from telemetry_ops.operators import labels, quality
from telemetry_ops.sources import datasets
from tests.helpers import MINUTES, at, incidents, telemetry


def _tables(spark):
    rows = telemetry(spark, [("a", m, m) for m in range(30)]).select("timestamp", "service_id", *METRICS)
    truth = spark.createDataFrame(
        [("i1", "a", "error_burst", at(10), at(12), at(14), at(16), 1.0)], datasets.INCIDENTS
    )
    found = labels.future_labels(rows, incidents(spark, [("a", 12)]), MINUTES, coverage_end=at(30))
    return {"telemetry": rows, "incidents": truth, "labels": found}


def test_dataset_round_trip_is_write_once_and_checked(spark, tmp_path):
    path = str(tmp_path / "data")
    datasets.write_dataset(_tables(spark), path)
    back = datasets.read_dataset(spark, path)
    assert back["telemetry"].count() == 30 and dict(back["labels"].dtypes)[TARGET] == "tinyint"
    with pytest.raises(AnalysisException):
        datasets.write_dataset(_tables(spark), path)
    back["incidents"].limit(1).write.mode("append").parquet(f"{path}/incidents")
    with pytest.raises(ValueError, match="incidents"):
        datasets.read_dataset(spark, path)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = telemetry(spark, [("a", m, m) for m in range(20)])
    one = datasets.table_fingerprint(rows, "t").first()
    assert datasets.table_fingerprint(rows.orderBy(F.desc("timestamp")), "t").first() == one
    changed = rows.withColumn("error_rate", F.when(rows.error_rate > 0.018, 0.5).otherwise(rows.error_rate))
    assert datasets.table_fingerprint(changed, "t").first()["digest"] != one["digest"]


def test_csv_round_trip(spark, tmp_path):
    rows = telemetry(spark, [("a", 1, 5)]).select("timestamp", "service_id", *METRICS)
    datasets.write_csv(rows, str(tmp_path / "csv"))
    assert datasets.read_csv(spark, str(tmp_path / "csv"), datasets.TELEMETRY).collect() == rows.collect()


def test_outcome_documents(spark, tmp_path):
    file = tmp_path / "o.json"
    file.write_text(json.dumps({
        "incidents": [{"source_id": "i", "service_id": "a", "start": "2025-01-01T00:10:00Z"},
                      {"source_id": "j", "service_id": "a", "start": "2025-01-01T00:10:00"}],
        "coverage": [{"source_id": "c", "service_id": "a", "start": "2025-01-01T00:00:00+00:00", "end": "2025-01-01T01:00:00Z"}],
    }, indent=1))
    starts, cover = datasets.read_outcomes(spark, str(file))
    assert [r["start"] for r in starts.orderBy("source_id").collect()] == [at(10), None]
    assert cover.first()["end"] == at(60)
    counts = {r["rule"]: r["rows"] for r in quality.count_violations(
        starts, quality.outcome_rules(F.lit(at(5)).cast("timestamp_ntz"), False)).collect()}
    assert counts == {"source_id_length": 0, "start_range": 1, "in_future": 1}


def test_matrix_files_keep_row_order(spark, tmp_path):
    for machine, n in (("m-1", 5), ("m-2", 300)):
        (tmp_path / f"{machine}.txt").write_text("".join(f"{i},{i / 2}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        found = datasets.read_matrix(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 305
    assert all(r["values"] == [float(r["ordinal"]), r["ordinal"] / 2] for r in found)


def test_capped_scan_fails_instead_of_truncating(spark):
    assert datasets.within_cap(spark.range(10), 10).count() == 10
    with pytest.raises(ValueError):
        datasets.within_cap(spark.range(11), 10)


def test_schema_and_rule_guards(spark):
    rows = telemetry(spark, [("a", 1, 5)]).select("timestamp", "service_id", *METRICS)
    quality.require_columns(rows, datasets.TELEMETRY)
    with pytest.raises(ValueError):
        quality.require_columns(rows.drop("error_rate"), datasets.TELEMETRY)
    quality.require_clean(quality.telemetry_violations(rows))
    with pytest.raises(ValueError, match="blank_service"):
        quality.require_clean(quality.telemetry_violations(rows.withColumn("service_id", F.lit(" "))))


def test_stage_guard(spark):
    rows = spark.createDataFrame([("train", 0), ("train", 1)], f"partition string, {TARGET} bigint")
    allowed = {"partition", TARGET}
    quality.require_stage(rows, "train", allowed)
    for bad in (rows.where(f"{TARGET} = 0"), rows.withColumn("partition", F.lit("test")), rows.withColumn("leak", F.lit(1)), rows.where("false")):
        with pytest.raises(ValueError):
            quality.require_stage(bad, "train", allowed)


@pytest.mark.parametrize("change, reason", [
    ({}, None),
    ({"timestamp": "2025-01-01T00:00:30Z"}, "timestamp_format"),
    ({"timestamp": "2025-01-01T00:00:00"}, "timestamp_format"),
    ({"timestamp": "2025-02-30T00:00:00Z"}, "timestamp_value"),
    ({"timestamp": "1999-01-01T00:00:00Z"}, "timestamp_range"),
    ({"service_id": "zz"}, "service"),
    ({"error_rate": "0.1"}, "metric_not_a_number"),
    ({"error_rate": None}, "metric_not_a_number"),
    ({"error_rate": -0.1}, "metric_range"),
    ({"error_rate": 1.5}, "error_rate_above_one"),
    ({"latency_p50_ms": 99.0}, "p95_below_p50"),
    ({"extra": 1}, "fields"),
])
def test_ingest_records(spark, change, reason):
    record = {"timestamp": "2025-01-01T00:01:00.000Z", "service_id": "a", **{m: 0.5 for m in METRICS}, **change}
    raw = spark.createDataFrame([(json.dumps(record),)], "body string")
    services = spark.createDataFrame([("a",)], "service_id string")
    assert quality.parse_records(raw, "body", services).first()["reason"] == reason
