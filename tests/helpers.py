"""Small frames on a one-minute grid."""

from datetime import datetime, timedelta

from telemetry_ops.grid import METRICS, Grid

ORIGIN = datetime(2025, 1, 1)
MINUTES = Grid(ORIGIN)
TINY = Grid(ORIGIN, chunk_points=4)  # chunks far shorter than a window


def at(minutes: float) -> datetime:
    return ORIGIN + timedelta(minutes=minutes)


def telemetry(spark, rows):
    """``(service, minute, value)``: every metric holds the value, percentages and rates scaled."""
    schema = "service_id string, timestamp timestamp_ntz, " + ", ".join(f"{m} double" for m in METRICS)
    return spark.createDataFrame(
        [(s, at(m), *[float(v) if i != 3 else float(v) / 1000 for i in range(7)]) for s, m, v in rows], schema
    )


def incidents(spark, rows):
    """``(service, onset minute)`` or ``(run, service, onset minute)``."""
    if rows and len(rows[0]) == 3:
        return spark.createDataFrame(
            [(r, s, f"{r}-{s}-{m}", "burst", at(m)) for r, s, m in rows],
            "run_id string, service_id string, incident_id string, incident_type string, incident_start timestamp_ntz",
        )
    return spark.createDataFrame(
        [(s, at(m)) for s, m in rows], "service_id string, incident_start timestamp_ntz"
    )


def predictions(spark, rows):
    """``(run, service, minute, probability)`` or with a target."""
    return spark.createDataFrame(
        [(r[0], r[1], at(r[2]), float(r[3]), int(r[4]) if len(r) > 4 else 0) for r in rows],
        "run_id string, service_id string, timestamp timestamp_ntz, probability double, target bigint",
    )


def by_minute(df, *columns):
    """Rows as ``{(service, minute): values}``."""
    found = {}
    for row in df.collect():
        minute = (row["timestamp"] - ORIGIN).total_seconds() / 60
        values = tuple(row[c] for c in columns)
        found[(row["service_id"], minute)] = values if len(values) > 1 else values[0]
    return found
