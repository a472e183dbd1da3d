"""Queries: scans, grid conformance and data-quality rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from telemetry_ops.functions.session import new_folder
from telemetry_ops.grid import METRICS, TARGET, Grid, moment
from telemetry_ops.operators import quality
from telemetry_ops.operators.describe import shift_metrics
from telemetry_ops.operators.labels import future_labels
from telemetry_ops.plans.registry import query
from telemetry_ops.plans.tables import COVERAGE_END, CUTOFF, ORIGIN
from telemetry_ops.sources import datasets
from telemetry_ops.sources.events import INCIDENT_TYPES

_METRICS = ", ".join(METRICS)


@query("scan_telemetry", f"SELECT service_id, timestamp, {_METRICS}, ingested_at FROM telemetry")
def scan_telemetry(t):
    return t.telemetry.select("service_id", "timestamp", *METRICS, "ingested_at")


@query(
    "asof_scan",
    f"""SELECT service_id, timestamp, {_METRICS}, ingested_at FROM telemetry
        WHERE timestamp >= TIMESTAMP '2024-01-02' AND timestamp < TIMESTAMP '2024-01-30'
          AND ingested_at <= TIMESTAMP '2024-01-29'""",
)
def asof_scan(t):
    found = datasets.asof_scan(t.telemetry, datetime(2024, 1, 2), datetime(2024, 1, 30), CUTOFF)
    return found.select("service_id", "timestamp", *METRICS, "ingested_at")


_COLUMNS = {
    "events": {"event_id": "", "event_type": "", "props": "", "ts": "time", "user_id": "", "value": "number"},
    "orders": {
        "o_custkey": "", "o_orderdate": "time", "o_orderkey": "", "o_orderpriority": "", "o_orderstatus": "",
        "o_totalprice": "number",
    },
    "lineitem": {
        "l_discount": "number", "l_extendedprice": "number", "l_linenumber": "", "l_linestatus": "", "l_orderkey": "",
        "l_partkey": "", "l_quantity": "number", "l_returnflag": "", "l_shipdate": "time", "l_suppkey": "", "l_tax": "number",
    },
}
_AS_TEXT = {"": "{}", "time": "epoch_us({})", "number": "CAST(floor({} * 1000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"}


def _fingerprint_sql(table: str) -> str:
    text = ", ".join(
        f"coalesce(CAST({_AS_TEXT[kind].format(name)} AS VARCHAR), '\\N')" for name, kind in _COLUMNS[table].items()
    )
    words = ", ".join(
        f"CAST(coalesce(sum(CAST(CAST('0x' || substr(h, {1 + 16 * i}, 16) AS UBIGINT) AS HUGEINT)), 0) AS VARCHAR)" for i in range(4)
    )
    return f"""SELECT '{table}' AS "table", count(*) AS rows, concat_ws('-', {words}) AS digest
      FROM (SELECT sha256(concat_ws('|', {text})) AS h FROM {table})"""


@query("table_fingerprint", " UNION ALL ".join(_fingerprint_sql(n) for n in ("events", "orders", "lineitem")))
def table_fingerprint(t):
    parts = [
        datasets.table_fingerprint(df, name, datasets.typed_text(df))
        for name, df in (("events", t.events), ("orders", t.read("orders")), ("lineitem", t.read("lineitem")))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_MATRIX = """SELECT CAST(label AS VARCHAR) AS machine,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ordinal, embedding FROM embeddings"""


def embedding_matrix(t):
    """Embeddings as ordinal matrices: the label is the machine, row order follows the id."""
    from telemetry_ops.functions.timeline import running

    rows = t.read("embeddings").select(
        F.col("label").cast("string").alias("machine"),
        "vec_id",
        F.call_function("div", F.col("vec_id"), F.lit(4096)).alias("_block"),
        F.transform("embedding", lambda x: x.cast("double")).alias("values"),
    )
    return running(
        rows, ["machine"], ["vec_id"], "_block", {"ordinal": ("sum", F.lit(1).cast("bigint"))}, False
    ).select("machine", "ordinal", "values")


@query(
    "matrix_scan",
    f"""SELECT machine, ordinal, CAST(len(embedding) AS BIGINT) AS width,
          CAST(embedding[1] AS DOUBLE) AS first_value, CAST(embedding[-1] AS DOUBLE) AS last_value
        FROM ({_MATRIX})""",
)
def matrix_scan(t):
    path = new_folder(t.spark, "matrix")
    datasets.write_matrix(embedding_matrix(t), path)
    rows = datasets.read_matrix(t.spark, path)
    return rows.select(
        "machine",
        "ordinal",
        F.size("values").cast("bigint").alias("width"),
        F.col("values")[0].alias("first_value"),
        F.element_at("values", -1).alias("last_value"),
    )


@query(
    "dq_matrix",
    f"""WITH data AS (
          SELECT machine, count(*) AS row_count, min(len(embedding)) AS narrow, max(len(embedding)) AS wide,
            count(*) FILTER (machine = '5' AND ordinal % 4 = 1) AS wild
          FROM ({_MATRIX}) GROUP BY machine),
        tags AS (
          SELECT CAST(label AS VARCHAR) AS machine, count(*) AS label_rows,
            count(*) FILTER (label = 6 AND vec_id % 2 = 0) AS bad FROM embeddings
          WHERE vec_id % 7 <> 0 OR label <> 3 GROUP BY ALL)
        SELECT coalesce(m.machine, d.machine, g.machine) AS machine,
          m.machine IS NULL AS unexpected_machine, d.machine IS NULL AS missing_data,
          g.machine IS NULL AS missing_labels,
          coalesce(narrow <> 64 OR wide <> 64, false) AS wrong_width,
          coalesce(wild > 0, false) AS not_finite, coalesce(bad > 0, false) AS label_not_binary,
          row_count IS DISTINCT FROM label_rows AS length_mismatch
        FROM (SELECT CAST(r AS VARCHAR) AS machine FROM range(1, 12) AS x(r)) AS m
        FULL JOIN data AS d ON m.machine = d.machine
        FULL JOIN tags AS g ON coalesce(m.machine, d.machine) = g.machine""",
)
def dq_matrix(t):
    """Machines 1 to 11 are expected; machine 3 lacks some label rows, machine 5 has infinite values and machine
    6 labels of 2, so every rule but the width's fires."""
    hurt = (F.col("machine") == "5") & (F.col("ordinal") % 4 == 1)
    values = F.transform("values", lambda x: F.when(hurt, F.lit(float("inf"))).otherwise(x))
    summary = datasets.matrix_summary(embedding_matrix(t).withColumn("values", values))
    vectors = t.read("embeddings")
    labels = (
        vectors.where((F.col("vec_id") % 7 != 0) | (F.col("label") != 3))
        .groupBy(F.col("label").cast("string").alias("machine"))
        .agg(
            F.count(F.lit(1)).alias("label_rows"),
            F.count_if((F.col("label") == 6) & (F.col("vec_id") % 2 == 0)).alias("bad_labels"),
        )
    )
    machines = t.spark.range(1, 12).select(F.col("id").cast("string").alias("machine"))
    return datasets.matrix_violations(summary, labels, machines, 64)


@query(
    "key_grid",
    """SELECT service_id, TIMESTAMP '2024-01-01' + to_hours(h) AS timestamp
       FROM services CROSS JOIN range(720) AS x(h)""",
)
def key_grid(t):
    return quality.key_grid(t.services, t.grid, 0, 720)


@query(
    "grid_missing",
    """SELECT service_id, TIMESTAMP '2024-01-01' + to_hours(h) AS timestamp
       FROM services CROSS JOIN range(720) AS x(h)
       EXCEPT SELECT service_id, timestamp FROM telemetry""",
)
def grid_missing(t):
    return quality.missing_keys(t.telemetry, quality.key_grid(t.services, t.grid, 0, 720))


@query(
    "grid_unexpected",
    """SELECT service_id, timestamp FROM telemetry
       EXCEPT SELECT service_id, TIMESTAMP '2024-01-01' + to_hours(h) AS timestamp
       FROM services CROSS JOIN range(24, 696) AS x(h)""",
)
def grid_unexpected(t):
    """The configured grid leaves out the first and the last day."""
    return quality.unexpected_keys(t.telemetry, quality.key_grid(t.services, t.grid, 24, 696))


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_partkey, count(*) AS rows FROM lineitem
       GROUP BY l_orderkey, l_partkey HAVING count(*) > 1""",
)
def duplicate_keys(t):
    return quality.duplicate_keys(t.read("lineitem"), ["l_orderkey", "l_partkey"])


_SHIFTED = f"""SELECT service_id, timestamp, ingested_at,
  request_rate_rps * 1.0 AS request_rate_rps, latency_p50_ms * 3.0 - 9.0 AS latency_p50_ms,
  latency_p95_ms * 1.0 AS latency_p95_ms, error_rate * 1.5 AS error_rate,
  cpu_utilisation_pct * 1.4 AS cpu_utilisation_pct,
  memory_utilisation_pct * 1.1 AS memory_utilisation_pct,
  dependency_latency_ms * 1.0 AS dependency_latency_ms FROM telemetry"""


def _shifted(t):
    """Telemetry under a stress shift that breaks several rules."""
    return shift_metrics(
        t.telemetry.drop("step"),
        scale={
            "latency_p50_ms": (3.0, -9.0),
            "error_rate": (1.5, 0.0),
            "cpu_utilisation_pct": (1.4, 0.0),
            "memory_utilisation_pct": (1.1, 0.0),
        },
    )


_HOUR_OF = "CAST(date_part('hour', timestamp) AS BIGINT) % 12"
_DAMAGED = f"""SELECT * REPLACE (
    CASE WHEN {_HOUR_OF} <> 1 THEN dependency_latency_ms END AS dependency_latency_ms,
    CASE WHEN {_HOUR_OF} = 2 THEN '  ' ELSE service_id END AS service_id,
    CASE WHEN {_HOUR_OF} = 3 THEN 'inf'::DOUBLE ELSE request_rate_rps END AS request_rate_rps)
  FROM (FROM ({_SHIFTED}) UNION ALL FROM ({_SHIFTED}) WHERE {_HOUR_OF} = 5)"""


def _damaged(t):
    """The shifted telemetry with nulls, blank services, infinities and repeated rows at some hours."""
    hour = F.hour("timestamp") % 12
    rows = _shifted(t)
    rows = rows.unionByName(rows.where(hour == 5))
    return rows.withColumns(
        {
            "dependency_latency_ms": F.when(hour != 1, F.col("dependency_latency_ms")),
            "service_id": F.when(hour == 2, F.lit("  ")).otherwise(F.col("service_id")),
            "request_rate_rps": F.when(hour == 3, F.lit(float("inf"))).otherwise(F.col("request_rate_rps")),
        }
    )


@query(
    "dq_telemetry",
    f"""WITH s AS ({_DAMAGED}),
        c AS (SELECT
          count(*) FILTER (timestamp IS NULL OR service_id IS NULL
            OR {" OR ".join(f"{m} IS NULL" for m in METRICS)}) AS missing,
          count(*) FILTER (trim(service_id) = '') AS blank,
          count(*) FILTER ({" OR ".join(f"isinf({m}) OR isnan({m})" for m in METRICS)}) AS wild,
          count(*) FILTER ({" OR ".join(f"{m} < 0" for m in METRICS)}) AS negative,
          count(*) FILTER (error_rate > 1) AS rate,
          count(*) FILTER (cpu_utilisation_pct > 100 OR memory_utilisation_pct > 100) AS pct,
          count(*) FILTER (latency_p95_ms < latency_p50_ms) AS swapped,
          count(*) - count(DISTINCT (service_id, timestamp)) AS dup FROM s)
        SELECT unnest(['null_value', 'blank_service', 'not_finite', 'negative',
                       'error_rate_above_one', 'percentage_above_100', 'p95_below_p50',
                       'duplicate_key']) AS rule,
               unnest([missing, blank, wild, negative, rate, pct, swapped, dup]) AS rows FROM c""",
)
def dq_telemetry(t):
    return quality.telemetry_violations(_damaged(t))


@query(
    "dq_constraints",
    f"""WITH s AS ({_SHIFTED}),
        c AS (SELECT
          count(*) FILTER (NOT ({" AND ".join(f"{m} >= 0" for m in METRICS)})) AS a,
          count(*) FILTER (NOT error_rate BETWEEN 0 AND 1) AS b,
          count(*) FILTER (NOT cpu_utilisation_pct BETWEEN 0 AND 100) AS c,
          count(*) FILTER (NOT memory_utilisation_pct BETWEEN 0 AND 100) AS d,
          count(*) FILTER (NOT latency_p50_ms <= latency_p95_ms) AS e,
          count(*) FILTER (date_trunc('minute', timestamp) <> timestamp) AS f,
          count(*) FILTER (timestamp > ingested_at) AS g FROM s)
        SELECT unnest(['metrics_non_negative', 'error_rate_fraction', 'cpu_percentage',
                       'memory_percentage', 'latency_order', 'whole_minute',
                       'arrival_after_event']) AS rule,
               unnest([a, b, c, d, e, f, g]) AS rows FROM c""",
)
def dq_constraints(t):
    return quality.constraint_violations(_shifted(t), quality.TELEMETRY_CONSTRAINTS)


_SINCE = "date_diff('hour', TIMESTAMP '2024-01-01', incident_start)"


@query(
    "dq_incidents",
    f"""WITH d AS (SELECT * REPLACE (
            CASE WHEN {_SINCE} % 11 = 0 THEN ' ' ELSE incident_type END AS incident_type,
            CASE WHEN {_SINCE} % 13 = 0 THEN 'nowhere' ELSE service_id END AS service_id,
            CASE WHEN {_SINCE} % 5 = 0 THEN severity + 2 ELSE severity END AS severity,
            CASE WHEN {_SINCE} % 17 = 0 THEN incident_start ELSE incident_end END AS incident_end)
          FROM (FROM incidents UNION ALL FROM incidents WHERE {_SINCE} % 7 = 0)),
        i AS (SELECT *, lead(precursor_start) OVER
          (PARTITION BY service_id ORDER BY precursor_start, incident_id) AS next_start FROM d),
        c AS (SELECT
          count(*) FILTER (trim(incident_id) = '' OR trim(service_id) = '' OR trim(incident_type) = '') AS blank,
          count(*) FILTER (incident_type NOT IN ('cpu_saturation', 'error_burst')) AS kind,
          count(*) FILTER (NOT severity BETWEEN 0.5 AND 1.5) AS sev,
          count(*) FILTER (NOT (precursor_start < incident_start AND incident_start < incident_end
                                AND incident_end < recovery_end)) AS life,
          count(*) FILTER (precursor_start < TIMESTAMP '2024-01-02'
                           OR recovery_end > TIMESTAMP '2024-01-31') AS outside,
          count(*) - count(DISTINCT incident_id) AS dup,
          count(*) FILTER (service_id = 'nowhere') AS lost,
          count(*) FILTER (recovery_end > next_start) AS overlap FROM i)
        SELECT unnest(['blank_text', 'unknown_type', 'severity_range', 'lifecycle_order',
                       'outside_coverage', 'duplicate_id', 'unknown_service',
                       'lifecycle_overlap']) AS rule,
               unnest([blank, kind, sev, life, outside, dup, lost, overlap]) AS rows FROM c""",
)
def dq_incidents(t):
    """Incidents damaged at some hours, two supported types, and a coverage that starts a day late."""
    since = t.grid.step("incident_start")
    rows = t.truth.unionByName(t.truth.where(since % 7 == 0))
    rows = rows.withColumns(
        {
            "incident_type": F.when(since % 11 == 0, F.lit(" ")).otherwise(F.col("incident_type")),
            "service_id": F.when(since % 13 == 0, F.lit("nowhere")).otherwise(F.col("service_id")),
            "severity": F.when(since % 5 == 0, F.col("severity") + 2).otherwise(F.col("severity")),
            "incident_end": F.when(since % 17 == 0, F.col("incident_start")).otherwise(F.col("incident_end")),
        }
    )
    return quality.incident_violations(
        rows,
        t.services,
        t.grid,
        coverage_start=moment(datetime(2024, 1, 2)),
        coverage_end=moment(COVERAGE_END),
        types=INCIDENT_TYPES[:2],
    )


@query(
    "dq_labels",
    """WITH short AS (SELECT service_id, timestamp, CAST(date_part('hour', timestamp) AS BIGINT) AS h, history_complete AS hc,
          timestamp + INTERVAL 9 HOUR < TIMESTAMP '2024-01-31' AS hz,
          CASE WHEN timestamp + INTERVAL 9 HOUR < TIMESTAMP '2024-01-31' THEN
            CAST(EXISTS (SELECT 1 FROM incidents AS i WHERE i.service_id = l.service_id
              AND i.incident_start > l.timestamp
              AND i.incident_start <= l.timestamp + INTERVAL 9 HOUR) AS BIGINT) END AS y
          FROM labelled AS l WHERE timestamp >= TIMESTAMP '2024-01-01 05:00:00'),
        own AS (SELECT service_id, CASE WHEN h = 9 THEN timestamp + INTERVAL 30 MINUTE ELSE timestamp END AS timestamp,
            CASE WHEN h = 6 THEN NOT hc WHEN h <> 1 THEN hc END AS hc,
            hz AND h <> 3 AS hz, CASE WHEN h = 2 THEN 7 WHEN h <> 4 THEN y END AS y, true AS own
          FROM (FROM short UNION ALL FROM short WHERE h = 8)),
        f AS (SELECT o.*, n.present, n.history_complete AS nhc, n.horizon_complete AS nhz, n.incident_within_horizon AS ny
          FROM own AS o FULL JOIN (SELECT *, true AS present FROM labelled) AS n
            ON o.service_id = n.service_id AND o.timestamp = n.timestamp),
        c AS (SELECT count(*) FILTER (own IS NULL) AS missing, count(*) FILTER (present IS NULL) AS extra,
          count(*) FILTER (own AND (hc IS NULL OR hz IS NULL)) AS flag,
          count(*) FILTER (y IS NOT NULL AND y NOT IN (0, 1)) AS odd,
          count(*) FILTER (NOT hz AND y IS NOT NULL) AS early, count(*) FILTER (hz AND y IS NULL) AS unknown,
          count(*) FILTER (own AND present AND hc IS DISTINCT FROM nhc) AS history,
          count(*) FILTER (own AND present AND hz IS DISTINCT FROM nhz) AS horizon,
          count(*) FILTER (own AND present AND y IS DISTINCT FROM ny) AS target FROM f),
        r AS (SELECT count(*) - count(DISTINCT (service_id, timestamp)) AS dup FROM own)
        SELECT unnest(['missing_label', 'unexpected_label', 'null_flag', 'target_not_binary',
            'known_beyond_horizon', 'unknown_within_horizon', 'differs_history_complete',
            'differs_horizon_complete', 'differs_incident_within_horizon', 'duplicate_label']) AS rule,
          unnest([missing, extra, flag, odd, early, unknown, history, horizon, target, dup]) AS rows FROM c, r""",
)
def dq_labels(t):
    """Labels built with a shorter horizon and without the first hours, damaged at some hours, audited."""
    shorter = Grid(ORIGIN, 3600, 15 * 3600, 9 * 3600)
    own = future_labels(t.rollup, t.truth, shorter, coverage_end=COVERAGE_END)
    own = own.where(F.col("timestamp") >= moment(datetime(2024, 1, 1, 5))).withColumn("_h", F.hour("timestamp"))
    own = own.unionByName(own.where("_h = 8"))
    hour, later = F.col("_h"), F.timestamp_add("MINUTE", F.lit(30).cast("bigint"), F.col("timestamp"))
    own = own.withColumns(
        {
            "timestamp": F.when(hour == 9, later).otherwise(F.col("timestamp")),
            "history_complete": F.when(hour == 6, ~F.col("history_complete")).when(hour != 1, F.col("history_complete")),
            "horizon_complete": F.col("horizon_complete") & (hour != 3),
            TARGET: F.when(hour == 2, F.lit(7)).when(hour != 4, F.col(TARGET)),
        }
    )
    return quality.label_violations(own.drop("_h"), t.labels)


@query(
    "ingest_reject",
    """SELECT service_id AS source, timestamp AS event_time,
         CASE WHEN cpu_utilisation_pct < 20 THEN 'timestamp_format'
              WHEN memory_utilisation_pct < 30 THEN 'timestamp_format'
              WHEN cpu_utilisation_pct < 30 THEN 'metric_not_a_number'
              WHEN latency_p95_ms > 120 THEN 'metric_range'
              WHEN error_rate > 0.9 THEN 'error_rate_above_one'
              WHEN error_rate > 0.7 THEN 'fields' END AS reason
       FROM telemetry""",
)
def ingest_reject(t):
    """Telemetry as JSON records, some of them damaged by rules on their own values."""
    cpu, rate, p95 = F.col("cpu_utilisation_pct"), F.col("error_rate"), F.col("latency_p95_ms")
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = (
        F.when(cpu < 20, F.concat(F.substring(stamp, 1, 17), F.lit("30Z")))
        .when(F.col("memory_utilisation_pct") < 30, stamp)
        .otherwise(F.concat(stamp, F.lit("Z")))
    )
    fields = [stamp.alias("timestamp"), F.col("service_id")]
    numbers = [F.col(m) for m in METRICS if m not in ("request_rate_rps", "latency_p95_ms", "error_rate")]
    numbers.append(F.when(p95 > 120, -p95).otherwise(p95).alias("latency_p95_ms"))
    numbers.append(F.when(rate > 0.9, rate * 2).otherwise(rate).alias("error_rate"))
    good = F.to_json(F.struct(*fields, *numbers, F.col("request_rate_rps")))
    quoted = F.to_json(
        F.struct(*fields, *numbers, F.col("request_rate_rps").cast("string").alias("request_rate_rps"))
    )
    extra = F.to_json(F.struct(*fields, *numbers, F.col("request_rate_rps"), F.lit(1).alias("note")))
    body = F.when(cpu < 30, quoted).when((rate > 0.7) & (rate <= 0.9) & (p95 <= 120), extra).otherwise(good)
    raw = t.telemetry.select(
        F.col("service_id").alias("source"), F.col("timestamp").alias("event_time"), body.alias("body")
    )
    return quality.parse_records(raw, "body", t.services).select("source", "event_time", "reason")


