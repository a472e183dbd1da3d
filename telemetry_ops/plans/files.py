"""Queries: sinks and boundary checks, each writing or reading a whole derived table."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetry_ops.functions.session import new_folder
from telemetry_ops.grid import METRICS, TARGET
from telemetry_ops.operators import features, outcomes, quality
from telemetry_ops.plans.registry import query
from telemetry_ops.plans.tables import CUTOFF
from telemetry_ops.sources import datasets

_M = ", ".join(METRICS)


@query("dataset_round_trip", f"SELECT timestamp, service_id, {_M} FROM telemetry")
def dataset_round_trip(t):
    """The three tables written once with their manifest, and the telemetry read back against it."""
    path = new_folder(t.spark, "dataset")
    labels = t.labels.select([f.name for f in datasets.LABELS])
    datasets.write_dataset({"telemetry": t.rollup, "incidents": t.truth, "labels": labels}, path)
    return datasets.read_dataset(t.spark, path)["telemetry"]


@query("csv_round_trip", f"SELECT timestamp, service_id, {_M} FROM telemetry")
def csv_round_trip(t):
    path = new_folder(t.spark, "csv") + "/telemetry"
    datasets.write_csv(t.telemetry.select([f.name for f in datasets.TELEMETRY]), path)
    return datasets.read_csv(t.spark, path, datasets.TELEMETRY)


@query(
    "outcome_documents",
    """SELECT 'incident' AS kind, source_id, service_id, CASE WHEN hour("start") <> 3 THEN "start" END AS "start",
         NULL::TIMESTAMP AS "end" FROM incident_starts
       UNION ALL SELECT 'certificate', source_id, service_id, "start", "end" FROM certificates""",
)
def outcome_documents(t):
    """One JSON document per service, read back; starts at 3 o'clock lack their offset and come back null."""
    path = new_folder(t.spark, "outcomes")
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    bare = F.when(F.hour("start") == 3, "").otherwise("Z")
    found = t.incident_starts.groupBy("service_id").agg(
        F.collect_list(F.struct("source_id", "service_id", F.concat(text("start"), bare).alias("start"))).alias("incidents")
    )
    sure = t.certificates.groupBy("service_id").agg(
        F.collect_list(
            F.struct(
                "source_id", "service_id", F.concat(text("start"), F.lit("+00:00")).alias("start"),
                F.concat(text("end"), F.lit("Z")).alias("end"),
            )
        ).alias("coverage")
    )
    documents = found.join(sure, "service_id", "full_outer").select(F.col("service_id").alias("sender"), "incidents", "coverage")
    # A file is one document.
    documents.repartition("sender").write.partitionBy("sender").option("ignoreNullFields", True).json(path)
    incidents, coverage = datasets.read_outcomes(t.spark, path)
    none = F.lit(None).cast("timestamp_ntz").alias("end")
    return incidents.select(F.lit("incident").alias("kind"), "source_id", "service_id", "start", none).unionByName(
        coverage.select(F.lit("certificate").alias("kind"), "source_id", "service_id", "start", "end")
    )


@query("capped_scan", "SELECT incident_id, service_id, incident_start FROM incidents")
def capped_scan(t):
    """Fails beyond one incident per row of telemetry; passes the rows on otherwise."""
    rows = t.truth.select("incident_id", "service_id", "incident_start")
    return datasets.within_cap(rows, t.rollup.count())


@query(
    "required_columns",
    f"""SELECT service_id, timestamp, {_M} FROM telemetry""",
)
def required_columns(t):
    typed = t.telemetry.select([F.col(f.name).cast(f.dataType) for f in datasets.TELEMETRY])
    return quality.require_columns(typed, datasets.TELEMETRY).select("service_id", "timestamp", *METRICS)


@query(
    "matrix_not_finite",
    """SELECT service_id, timestamp FROM features
       WHERE date_part('hour', timestamp) % 7 = 2 OR error_rate__mean = 0""",
)
def matrix_not_finite(t):
    """Feature rows damaged in two ways: an infinity at some hours, a null where no request failed."""
    name = "error_rate__mean"
    hurt = F.when(F.hour("timestamp") % 7 == 2, F.lit(float("inf"))).when(F.col(name) != 0, F.col(name))
    rows = t.features.withColumn(name, hurt)
    bad = features.not_finite_row()
    features.feature_matrix(rows.select(list(features.FEATURES)))
    return rows.where(bad).select("service_id", "timestamp")


@query(
    "stage_guard",
    f"""SELECT run_id, service_id, timestamp, {TARGET} FROM modelling_rows WHERE partition = 'train'""",
)
def stage_guard(t):
    keys = ["run_id", "service_id", "timestamp"]
    rows = t.rule_rows.where("partition = 'train'").select(*keys, "partition", TARGET)
    return quality.require_stage(rows, "train", {*keys, "partition", TARGET}).select(*keys, TARGET)


@query(
    "outcome_rules",
    """WITH hurt AS (SELECT CASE WHEN h % 5 <> 0 THEN source_id WHEN h % 2 = 0 THEN '' END AS source_id,
           CASE WHEN h % 7 <> 0 THEN "start" WHEN h % 2 = 0 THEN "start" - INTERVAL 40 YEAR END AS "start",
           CASE WHEN h % 3 <> 0 THEN "end" WHEN h % 2 = 0 THEN "start" END AS "end"
         FROM (SELECT *, date_diff('hour', TIMESTAMP '2024-01-01', "start") AS h FROM certificates))
       SELECT unnest(['empty_interval', 'end_range', 'in_future', 'source_id_length', 'start_range']) AS rule,
         unnest([count(*) FILTER ("end" <= "start"),
           count(*) FILTER ("end" IS NULL OR year("end") NOT BETWEEN 2000 AND 2100),
           count(*) FILTER (greatest("start", "end") > TIMESTAMP '2024-01-29'),
           count(*) FILTER (source_id IS NULL OR length(source_id) NOT BETWEEN 1 AND 200),
           count(*) FILTER ("start" IS NULL OR year("start") NOT BETWEEN 2000 AND 2100)]) AS rows FROM hurt""",
)
def outcome_rules(t):
    """Certificates damaged so that every rule fires."""
    hour = t.grid.step("start")
    old = F.timestamp_add("YEAR", F.lit(-40).cast("bigint"), F.col("start"))
    rows = t.certificates.select(
        F.when(hour % 5 != 0, F.col("source_id")).when(hour % 2 == 0, F.lit("")).alias("source_id"),
        F.when(hour % 7 != 0, F.col("start")).when(hour % 2 == 0, old).alias("start"),
        F.when(hour % 3 != 0, F.col("end")).when(hour % 2 == 0, F.col("start")).alias("end"),
    )
    return quality.count_violations(rows, quality.outcome_rules(F.lit(CUTOFF).cast("timestamp_ntz"), coverage=True))


@query(
    "import_certificates",
    """WITH old AS (SELECT * FROM certificates WHERE recorded_at <= TIMESTAMP '2024-01-20'),
        batch AS (SELECT source_id, service_id, "start",
            CASE WHEN date_diff('hour', TIMESTAMP '2024-01-01', "start") % 48 = 0
              THEN "end" + INTERVAL 1 HOUR ELSE "end" END AS "end" FROM certificates)
       SELECT b.source_id, b.service_id, b."start", b."end", CAST(1 AS BIGINT) AS records,
         CASE WHEN greatest(b."start", b."end") > TIMESTAMP '2024-01-29' THEN 'future'
              WHEN o.source_id IS NOT NULL AND o."end" <> b."end" THEN 'conflict'
              WHEN o.source_id IS NOT NULL THEN 'unchanged' ELSE 'new' END AS status
       FROM batch AS b LEFT JOIN old AS o USING (source_id)""",
)
def import_certificates(t):
    """The coverage half of an import: part of the certificates is stored, some arrive altered."""
    altered = F.timestamp_add("HOUR", F.lit(1).cast("bigint"), F.col("end"))
    end = F.when(t.grid.step("start") % 48 == 0, altered).otherwise(F.col("end")).alias("end")
    batch = t.certificates.select("source_id", "service_id", "start", end)
    stored = t.certificates.where("recorded_at <= timestamp_ntz'2024-01-20 00:00:00'")
    _, found = outcomes.import_outcomes(t.incident_starts, batch, t.incident_starts, stored, t.grid, CUTOFF)
    return found
