"""Queries: streaming jobs run over the whole tables, file by file, until nothing is left."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.session import new_folder, stage
from telemetry_ops.grid import FEATURES, METRICS, moment
from telemetry_ops.operators.drift import DriftConfig, drift_reference, to_long
from telemetry_ops.operators.features import window_features
from telemetry_ops.plans.monitoring import _DELAYED
from telemetry_ops.plans.registry import query
from telemetry_ops.plans.scoring import _episodes, rounded
from telemetry_ops.plans.tables import CUTOFF, ORIGIN, SCALES, THRESHOLD
from telemetry_ops.streaming import jobs
from telemetry_ops.streaming.runner import local_state_partitions

_M = ", ".join(METRICS)
LATENESS = "1 day"
#: A batch brings half a month of hours, so chunks of ten days are few calls of a processor, each with many rows.
CHUNK_POINTS = 240
FILES, FILES_PER_BATCH = 8, 4
END_MARK = "~end"  # service of the closing row that moves the watermark past all data
BEYOND = "INTERVAL 100 DAYS"  # how far behind the last row the closing row lies


def _in_order(spark, path: str) -> None:
    """Sets the files' times to the order of their names, in which a stream then reads them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().toString() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-"))
    begin = int(time.time() * 1000) - 3_600_000
    for k, name in enumerate(names):
        store.setTimes(spark._jvm.org.apache.hadoop.fs.Path(name), begin + 1000 * k, -1)


def arriving(
    t,
    df: DataFrame,
    order: str,
    times: tuple[str, ...],
    close: bool = False,
    path: str | None = None,
    files: int = FILES,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """Write a table as files in time order and read it back as a stream, some files per batch.

    ``times`` become zoned timestamps. With ``close`` a last file holds a row far behind all others. With a ``path``
    the files join those of an earlier call, as what arrives later.
    """
    later = path is not None
    path = path or new_folder(t.spark, "arriving")
    zoned = df.select(*[F.col(c).cast("timestamp").alias(c) if c in times else F.col(c) for c in df.columns])
    zoned.repartitionByRange(files, order).write.mode("append").parquet(path)
    if not later:
        _in_order(t.spark, path)
    if close:
        end = t.spark.read.schema(zoned.schema).parquet(path).agg(F.max(F.greatest(*times, times[0])).alias("end"))
        far = F.col("end") + F.expr(BEYOND)
        row = [
            far.alias(f.name)
            if f.name in times
            else F.lit(END_MARK if f.dataType.simpleString() == "string" else 0).cast(f.dataType).alias(f.name)
            for f in zoned.schema
        ]
        end.select(*row).write.mode("append").parquet(path)
    return t.spark.readStream.schema(zoned.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _state(t):
    return local_state_partitions(t.spark)


@query(
    "stream_ingest",
    f"""SELECT service_id, timestamp, {_M} FROM telemetry
        WHERE timestamp <= TIMESTAMP '2024-01-29' AND memory_utilisation_pct >= 30""",
)
def stream_ingest(t):
    """Telemetry as JSON, low-memory rows damaged; every row arrives twice."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    good = F.concat(stamp, F.when(F.col("memory_utilisation_pct") < 30, "").otherwise("Z"))
    body = F.to_json(F.struct(good.alias("timestamp"), "service_id", *METRICS))
    records = t.rollup.select(body.alias("body"), "step").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    stream = arriving(t, records, "step", ())
    target, rejects = new_folder(t.spark, "ingested"), new_folder(t.spark, "rejects")
    jobs.ingest_stream(
        stream,
        "body",
        target,
        rejects,
        new_folder(t.spark, "ingest-progress"),
        services=t.services,
        now=moment(datetime(2024, 1, 29)),
        state_partitions=_state(t),
    )
    return t.spark.read.schema(jobs.STORED).parquet(target).drop("ingested_at")


_LATE_DAYS = 3


@query(
    "stream_ingest_counts",
    f"""WITH r AS (SELECT *, memory_utilisation_pct < 30 OR timestamp > TIMESTAMP '2024-01-29' AS bad,
           step % 11 = 3 AS second, memory_utilisation_pct < 30 AS damaged FROM telemetry),
        m AS (SELECT max(timestamp) - INTERVAL {_LATE_DAYS} DAY AS mark FROM r WHERE NOT second AND NOT bad),
        a AS (
          SELECT CASE WHEN bad THEN 'rejected' ELSE unnest(['inserted', 'unchanged']) END AS kind FROM r WHERE NOT second AND NOT bad
          UNION ALL SELECT unnest(['rejected', 'rejected']) FROM r WHERE NOT second AND bad
          UNION ALL SELECT CASE WHEN damaged THEN 'rejected' WHEN timestamp < mark THEN 'late' WHEN bad THEN 'rejected'
            WHEN second THEN 'inserted' ELSE 'unchanged' END FROM r, m WHERE second OR step % 13 = 5)
       SELECT count(*) FILTER (kind = 'inserted') AS inserted, count(*) FILTER (kind = 'unchanged') AS unchanged,
         count(*) FILTER (kind = 'rejected') AS rejected, count(*) FILTER (kind = 'late') AS late,
         count(*) AS input, count(*) FILTER (kind = 'inserted') AS stored FROM a""",
)
def stream_ingest_counts(t):
    """Every record is counted once. Every eleventh step comes after all others, mostly too late, and some rows come again."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    good = F.concat(stamp, F.when(F.col("memory_utilisation_pct") < 30, "").otherwise("Z"))
    body = F.to_json(F.struct(good.alias("timestamp"), "service_id", *METRICS)).alias("body")
    rows = t.rollup.select(body, "step")
    second = F.col("step") % 11 == 3
    twice = rows.where(~second).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    after = rows.where(second | (F.col("step") % 13 == 5)).withColumn("copy", F.lit(2))
    folders = [new_folder(t.spark, n) for n in ("arriving", "ingested", "rejects", "late", "counts", "ingest-progress")]
    path, target, rejects, late, counts, progress = folders
    for wave, files in ((twice, FILES), (after, 1)):
        jobs.ingest_stream(
            arriving(t, wave, "step", (), path=path, files=files, files_per_batch=FILES),
            "body", target, rejects, progress,
            services=t.services, now=moment(datetime(2024, 1, 29)), late=late, delay=f"{_LATE_DAYS} DAYS", counts=counts,
            state_partitions=_state(t),
        )
    stored = t.spark.read.schema(jobs.STORED).parquet(target).count()
    kinds = ("inserted", "unchanged", "rejected", "late")
    return jobs.ingest_counts(t.spark, counts).agg(
        *[F.sum(k).alias(k) for k in kinds], F.sum(sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))).alias("input"),
        F.lit(stored).cast("bigint").alias("stored"),
    )


def _features(t, metrics, close: bool = False):
    stream = arriving(t, t.rollup.select("service_id", "timestamp", *METRICS), "timestamp", ("timestamp",), close)
    return jobs.sliding_features(
        stream,
        t.grid,
        delay=LATENESS,
        coverage_start=F.lit(ORIGIN).cast("timestamp"),
        scales=SCALES,
        metrics=metrics,
        chunk_points=CHUNK_POINTS,
    )


@query("stream_features", "SELECT * FROM features")
def stream_features(t):
    path = new_folder(t.spark, "features")
    features = _features(t, METRICS)
    jobs.feature_table(features, path, new_folder(t.spark, "feature-progress"), _state(t))
    found = t.spark.read.parquet(path)
    return found.select("service_id", "timestamp", *FEATURES)


@query(
    "stream_score",
    """SELECT service_id, timestamp, 'model-mean' AS model_id, error_rate__mean AS probability FROM features""",
)
def stream_score(t):
    path = new_folder(t.spark, "scores")
    jobs.score_stream(
        _features(t, ("error_rate",)),
        lambda df: df.withColumn("probability", F.col("error_rate__mean")),
        "model-mean",
        path,
        new_folder(t.spark, "score-progress"),
        now=F.localtimestamp(),
        state_partitions=_state(t),
    )
    return t.spark.read.parquet(path).select("service_id", "timestamp", "model_id", "probability")


_DRIFTED = (*FEATURES, "probability")


@query(
    "stream_drift",
    f"""WITH long AS (SELECT timestamp, feature, value FROM (UNPIVOT
            (SELECT timestamp, {", ".join(FEATURES)}, error_rate__mean AS probability FROM features)
            ON {", ".join(_DRIFTED)} INTO NAME feature VALUE value)),
        edge AS (SELECT feature, count(*) AS n, list_sort(list_distinct(
            quantile_cont(value, [{", ".join(str(i / 10) for i in range(11))}]))) AS edges
          FROM long GROUP BY feature),
        hit AS (SELECT time_bucket(INTERVAL 5 DAY, timestamp, TIMESTAMP '1970-01-01') AS "start", feature,
            len(list_filter(edges, lambda e: e <= value)) + CAST(value > edges[-1] AS BIGINT) AS bin,
            count(*) AS n FROM long JOIN edge USING (feature) GROUP BY ALL),
        share AS (SELECT feature, bin, sum(n) AS n FROM hit GROUP BY ALL),
        total AS (SELECT "start", feature, CAST(sum(n) AS BIGINT) AS n FROM hit GROUP BY ALL),
        s AS (SELECT t."start", b.feature, t.n AS samples, coalesce(h.n, 0) / t.n::DOUBLE + 0.0001 AS a,
            coalesce(r.n, 0) / b.n::DOUBLE + 0.0001 AS e
          FROM (SELECT *, unnest(range(len(edges) + 2)) AS bin FROM edge) AS b
          JOIN total AS t USING (feature)
          LEFT JOIN share AS r ON r.feature = b.feature AND r.bin = b.bin
          LEFT JOIN hit AS h ON h.feature = b.feature AND h.bin = b.bin AND h."start" = t."start"),
        p AS (SELECT "start", feature, samples, sum((a / sa - e / se) * ln((a / sa) / (e / se))) AS psi
          FROM (SELECT *, sum(a) OVER w AS sa, sum(e) OVER w AS se FROM s
                WINDOW w AS (PARTITION BY "start", feature)) GROUP BY ALL)
       SELECT "start", "start" + INTERVAL 5 DAY AS "end", feature,
         CASE WHEN samples < 50 THEN 'insufficient' WHEN psi >= 0.25 THEN 'severe'
              WHEN psi >= 0.1 THEN 'warning' ELSE 'stable' END AS status, samples,
         CASE WHEN samples >= 50 THEN round(psi, 9) END AS psi FROM p""",
)
def stream_drift(t):
    """Five-day intervals against the whole month: windows and drift counters are two stateful steps of one query."""
    # Of the staged telemetry, which the stream reads too, so that it is built once.
    rows = window_features(t.rollup, t.grid, scales=SCALES).withColumn("probability", F.col("error_rate__mean"))
    reference = stage(drift_reference(stage(to_long(rows, list(_DRIFTED)), "features-long"), 10), "reference")
    path = new_folder(t.spark, "drift")
    jobs.drift_stream(
        jobs.scored_features(_features(t, METRICS, close=True), lambda df: F.col("error_rate__mean")),
        reference,
        DriftConfig(minimum_samples=50),
        "5 days",
        path,
        new_folder(t.spark, "drift-progress"),
        state_partitions=_state(t),
    )
    return rounded(t.spark.read.parquet(path), "psi")


@query(
    "stream_health",
    """WITH r AS (SELECT service_id, timestamp, epoch(ingested_at - timestamp)::DOUBLE AS lag,
            time_bucket(INTERVAL 5 DAY, timestamp, TIMESTAMP '1970-01-01') AS "start" FROM telemetry),
        i AS (SELECT DISTINCT "start" FROM r)
       SELECT i."start", i."start" + INTERVAL 5 DAY AS "end", s.service_id, count(r.timestamp) AS rows,
         CAST(120 AS BIGINT) AS expected_points, 120 - count(r.timestamp) AS missing_points,
         count(r.timestamp) / 120.0::DOUBLE AS grid_completeness,
         epoch(i."start" + INTERVAL 5 DAY - max(r.timestamp))::DOUBLE AS event_freshness_seconds,
         min(lag) AS lag_min_seconds, quantile_cont(lag, 0.5) AS lag_median_seconds, max(lag) AS lag_max_seconds
       FROM i CROSS JOIN services AS s LEFT JOIN r ON r."start" = i."start" AND r.service_id = s.service_id
       GROUP BY i."start", s.service_id""",
)
def stream_health(t):
    times = ("timestamp", "ingested_at")
    path = new_folder(t.spark, "health")
    jobs.health_stream(
        arriving(t, t.rollup.select("service_id", *times), "timestamp", times, close=True),
        stage(t.services, "services"),
        t.grid,
        timedelta(days=5),
        path,
        new_folder(t.spark, "health-progress"),
        delay=LATENESS,
        state_partitions=_state(t),
    )
    return t.spark.read.parquet(path)


@query(
    "stream_delayed",
    f"WITH {_DELAYED} SELECT id, service_id, timestamp, probability, reason, target FROM delayed",
)
def stream_delayed(t):
    """Records in the order in which they became known, up to the cutoff of the batch form."""
    path = new_folder(t.spark, "delayed")
    predictions = t.stored_predictions.select("id", "service_id", "timestamp", "probability", "produced_at")
    onsets = t.incident_starts.select("service_id", "start", "recorded_at")
    certificates = t.certificates.select("service_id", "start", "end", "recorded_at")
    jobs.delayed_stream(
        arriving(t, predictions, "produced_at", ("timestamp", "produced_at"), close=True),
        arriving(t, onsets, "recorded_at", ("start", "recorded_at"), close=True),
        arriving(t, certificates, "recorded_at", ("start", "end", "recorded_at"), close=True),
        t.grid,
        path,
        new_folder(t.spark, "delayed-progress"),
        delay=LATENESS,
        patience=timedelta(days=10),
        cutoff=CUTOFF,
        state_partitions=_state(t),
    )
    return t.spark.read.parquet(path).where(F.col("service_id") != END_MARK)


@query(
    "stream_episodes",
    f"""SELECT candidate, run_id, service_id, partition, "start", "end", alert_points
        FROM ({_episodes("partition, candidate, run_id, service_id", str(THRESHOLD))})""",
)
def stream_episodes(t):
    keys = ["candidate", "run_id", "service_id", "partition"]
    scores = t.predictions.select(*keys, "timestamp", "probability")
    path = new_folder(t.spark, "episodes")
    stream = arriving(t, scores, "timestamp", ("timestamp",), close=True)
    # The closing row must pass the alert filter to move the watermark.
    stream = stream.withColumn(
        "probability", F.when(F.col("service_id") == END_MARK, 1.0).otherwise(F.col("probability"))
    )
    jobs.episode_stream(
        stream,
        t.grid,
        THRESHOLD,
        keys,
        path,
        new_folder(t.spark, "episode-progress"),
        delay=LATENESS,
        state_partitions=_state(t),
    )
    return t.spark.read.parquet(path).where(F.col("service_id") != END_MARK)
