"""Readers, write-once writers, fingerprints and guards for stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetry_ops.functions.timeline import running
from telemetry_ops.grid import METRICS, TARGET, moment

_STAMP = T.TimestampNTZType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


TELEMETRY = _schema(
    ("timestamp", _STAMP), ("service_id", T.StringType()), *[(m, T.DoubleType()) for m in METRICS]
)
INCIDENTS = _schema(
    ("incident_id", T.StringType()),
    ("service_id", T.StringType()),
    ("incident_type", T.StringType()),
    ("precursor_start", _STAMP),
    ("incident_start", _STAMP),
    ("incident_end", _STAMP),
    ("recovery_end", _STAMP),
    ("severity", T.DoubleType()),
)
LABELS = _schema(
    ("timestamp", _STAMP),
    ("service_id", T.StringType()),
    ("history_complete", T.BooleanType()),
    ("horizon_complete", T.BooleanType()),
    (TARGET, T.ByteType()),
)
DATASET = {"telemetry": TELEMETRY, "incidents": INCIDENTS, "labels": LABELS}
MANIFEST = _schema(("table", T.StringType()), ("rows", T.LongType()), ("digest", T.StringType()))


def write_dataset(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables and a manifest of counts and digests; fails if the output exists."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        _ordered(df, DATASET[name]).write.mode("errorifexists").parquet(f"{path}/{name}")
    manifest = None
    for name in tables:
        part = table_fingerprint(spark.read.parquet(f"{path}/{name}"), name)
        manifest = part if manifest is None else manifest.unionByName(part)
    # The manifest comes last: a folder without one is an unfinished write.
    manifest.write.mode("errorifexists").parquet(f"{path}/manifest")


def _ordered(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def read_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Typed read of the three tables; counts and digests must match the manifest."""
    tables = {n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in DATASET.items()}
    found = None
    for name, df in tables.items():
        part = table_fingerprint(df, name)
        found = part if found is None else found.unionByName(part)
    stored = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    wrong = manifest_differences(stored, found).collect()
    if wrong:
        raise ValueError(f"Tables differ from the manifest: {[r['table'] for r in wrong]}")
    return tables


def typed_text(df: DataFrame) -> Column:
    """A row's columns, sorted by name, as text that any engine can write: times as microseconds, doubles as
    millionths (finer differences are left to the JSON form)."""
    kinds = {"timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.unix_micros(c.cast("timestamp"))}

    def text(name):
        kind = dict(df.dtypes)[name]
        value = F.col(name)
        if kind in ("double", "float"):
            value = F.floor(value * 1e6 + 0.5)
        return F.coalesce(kinds.get(kind, lambda c: c)(value).cast("string"), F.lit("\\N"))

    return F.concat_ws("|", *[text(c) for c in sorted(df.columns)])


def table_fingerprint(df: DataFrame, name: str, body: Column | None = None) -> DataFrame:
    """Row count and an order-insensitive digest: the four 64-bit words of each row's SHA-256, summed.

    ``body`` is the text of a row; without it, JSON of all columns, which keeps every digit.
    """
    if body is None:
        body = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    row = F.sha2(body, 256)
    words = [F.conv(F.substring(row, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.coalesce(F.sum(w), F.lit(0)).cast("string") for w in words]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *sums).alias("digest")).select(
        F.lit(name).alias("table"), "rows", "digest"
    )


def manifest_differences(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Tables that are missing, unexpected, or differ in count or digest."""
    a, b = stored.alias("a"), found.alias("b")
    same = F.col("a.rows").eqNullSafe(F.col("b.rows")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
    return (
        a.join(b, F.col("a.table") == F.col("b.table"), "full_outer")
        .where(~same)
        .select(F.coalesce("a.table", "b.table").alias("table"))
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def asof_scan(
    stored: DataFrame,
    start: datetime | Column,
    end: datetime | Column,
    cutoff: datetime | Column,
    services: list[str] | None = None,
) -> DataFrame:
    """Rows of ``[start, end)`` that had arrived by the cutoff; the filters reach the file scan."""
    kept = stored.where(
        (F.col("timestamp") >= moment(start))
        & (F.col("timestamp") < moment(end))
        & (F.col("ingested_at") <= moment(cutoff))
    )
    return kept.where(F.col("service_id").isin(services)) if services else kept


def within_cap(df: DataFrame, cap: int) -> DataFrame:
    """Fail, rather than truncate, when a result has more than ``cap`` rows."""
    if df.limit(cap + 1).count() > cap:
        raise ValueError(f"More than {cap} rows")
    return df


OUTCOMES = T.StructType(
    [
        T.StructField(
            "incidents",
            T.ArrayType(
                _schema(
                    ("source_id", T.StringType()), ("service_id", T.StringType()), ("start", T.StringType())
                )
            ),
        ),
        T.StructField(
            "coverage",
            T.ArrayType(
                _schema(
                    ("source_id", T.StringType()),
                    ("service_id", T.StringType()),
                    ("start", T.StringType()),
                    ("end", T.StringType()),
                )
            ),
        ),
    ]
)


def read_outcomes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Outcome documents (``incidents[]``, ``coverage[]``) as two tables.

    Times carry an explicit UTC offset; text without one gives a null, which the rules reject.
    """
    documents = spark.read.schema(OUTCOMES).option("multiLine", True).json(path)

    def utc(name):
        explicit = F.col(name).rlike("(Z|[+]00:00)$")
        bare = F.regexp_replace(F.col(name), "(Z|[+]00:00)$", "")
        return F.when(explicit, bare.try_cast("timestamp_ntz")).alias(name)

    incidents = documents.select(F.inline("incidents"))
    coverage = documents.select(F.inline("coverage"))
    return (
        incidents.select("source_id", "service_id", utc("start")),
        coverage.select("source_id", "service_id", utc("start"), utc("end")),
    )


def write_matrix(rows: DataFrame, path: str) -> None:
    """Headerless comma-separated rows (``machine, ordinal, values``), one folder per machine.

    Rows are range-partitioned by machine and ordinal, so a long machine spans several files whose
    numbers ascend in row order.
    """
    (
        rows.repartitionByRange("machine", "ordinal")
        .sortWithinPartitions("machine", "ordinal")
        .select("machine", F.array_join(F.col("values").cast("array<string>"), ",").alias("value"))
        .write.mode("errorifexists")
        .partitionBy("machine")
        .text(path)
    )


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Headerless numeric matrices whose row order counts: ``machine, ordinal, values``.

    The machine is the ``machine=`` folder, or else the file name without its suffix. A line's
    ordinal is its position in its file block plus the lines of all earlier blocks and files of the
    machine, so files may be split over tasks.
    """
    lines = spark.read.text(path)
    if "machine" in lines.columns:
        machine = F.col("machine").cast("string")
    else:
        machine = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    lines = lines.select(
        machine.alias("machine"),
        # Part numbers have five digits or more, so they are compared as numbers.
        F.struct(
            F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint"), F.lit(-1).cast("bigint")).alias("part"),
            "_metadata.file_path",
            "_metadata.file_block_start",
        ).alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    ).where("value <> ''")
    counted = running(
        lines, ["machine"], ["_line"], "_block", {"ordinal": ("sum", F.lit(1).cast("bigint"))}, False
    )
    values = F.transform(F.split("value", ","), lambda x: x.try_cast("double"))
    return counted.select("machine", "ordinal", values.alias("values"))


def matrix_summary(rows: DataFrame) -> DataFrame:
    """Per machine: rows, narrowest and widest row, and rows with non-finite values."""
    bad = F.exists(
        "values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return rows.groupBy("machine").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.size("values")).cast("bigint").alias("min_width"),
        F.max(F.size("values")).cast("bigint").alias("max_width"),
        F.count_if(bad).alias("bad_rows"),
    )


def matrix_violations(
    summary: DataFrame, label_summary: DataFrame, machines: DataFrame, width: int
) -> DataFrame:
    """Inventory, width, finiteness and data/label length rules for every machine, one row each.

    ``label_summary`` has ``machine, label_rows, bad_labels``.
    """
    return (
        machines.withColumn("expected", F.lit(True))
        .join(summary, "machine", "full_outer")
        .join(label_summary, "machine", "full_outer")
        .select(
            "machine",
            F.col("expected").isNull().alias("unexpected_machine"),
            F.col("rows").isNull().alias("missing_data"),
            F.col("label_rows").isNull().alias("missing_labels"),
            F.coalesce(
                (F.col("min_width") != width) | (F.col("max_width") != width), F.lit(False)
            ).alias("wrong_width"),
            F.coalesce(F.col("bad_rows") > 0, F.lit(False)).alias("not_finite"),
            F.coalesce(F.col("bad_labels") > 0, F.lit(False)).alias("label_not_binary"),
            (~F.col("rows").eqNullSafe(F.col("label_rows"))).alias("length_mismatch"),
        )
    )
