"""Running a streaming query over what is available, with a first-write-wins table as sink."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetry_ops.grid import moment


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    output_mode: str = "append",
    state_partitions: int | None = None,
) -> dict[str, int]:
    """Process everything available, batch by batch, and stop; returns ``batches, rows`` and ``late``.

    ``late`` counts the rows that stateful steps refused because the watermark had passed them (a row
    counts once per copy that such a step was sent). ``state_partitions`` fixes the number of state partitions
    for this query only; a running query keeps a copy of the settings it was started with. State lies in
    RocksDB, which stateful processors need and which keeps it off the heap.
    """
    spark = stream.sparkSession
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.streaming.numRecentProgressUpdates": "100000",
    }
    if state_partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        running = (
            stream.writeStream.outputMode(output_mode)
            .foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    running.awaitTermination()
    steps = running.recentProgress
    late = sum(o.numRowsDroppedByWatermark for p in steps for o in p.stateOperators)
    return {"batches": len({p.batchId for p in steps}), "rows": sum(p.numInputRows for p in steps), "late": late}


def local_state_partitions(spark: SparkSession) -> int:
    """No more state partitions than the session shuffles to, nor than it has cores."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def around(stored: DataFrame, batch: DataFrame, time: str) -> DataFrame:
    """The part of a table whose times lie within the batch's; the bounds reach the file scan."""
    bounds = batch.agg(F.min(time), F.max(time)).first()
    if bounds[0] is None:
        return stored.where("false")
    low, high = (moment(v) if isinstance(v, datetime) else F.lit(v) for v in bounds)
    return stored.where(F.col(time).between(low, high))


def append_new(batch: DataFrame, path: str, keys: list[str], time: str) -> None:
    """Append rows whose key the table does not hold yet; replaying a batch adds nothing.

    ``time`` is fixed by the key, so only the stored rows of the batch's time range are read. Equal
    keys inside the batch must hold equal rows.
    """
    batch = batch.persist()
    try:
        stored = around(read_table(batch.sparkSession, path, batch.schema), batch, time)
        fresh = batch.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(path)
    finally:
        batch.unpersist()
