"""Status changes held in the operator state of a stream: one entry per key, no log to merge.

The stream is one aggregation in update mode. Its state lies in RocksDB on the executors and,
as a change log per batch, in the checkpoint, so a batch writes what it changed and a restart,
or a lost executor, goes on from the last batch that was committed. The state is read back
from the checkpoint by Spark's state data source, by key if wanted.

``arrival`` must grow over the whole stream (an offset or a sequence number): of changes of one
instant the one that arrived first stays, also if a later batch brings the other. Late changes
count by their own instant. As in ``latest_state`` a null status is blank, a null instant is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.functions.text import text
from gleanery.operators.state import KEY
from gleanery.schema import STATE
from gleanery.session import file_system

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The settings a query takes over when it starts; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    for k, v in _ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def newest_changes(changes: DataFrame) -> DataFrame:
    """(space, id, newest) of changes (space, id, status, ts, arrival), as a batch or a stream."""
    order = F.struct(F.coalesce("ts", F.lit(0)).alias("ts"), (-F.col("arrival")).alias("earlier"), text(F.col("status")).alias("status"))
    return changes.groupBy(*KEY).agg(F.max(order).alias("newest"))


def start_keyed_state(changes: DataFrame, checkpoint: str, sink: str = "noop", **trigger) -> StreamingQuery:
    """Fold a stream of (space, id, status, ts, arrival) into the state below ``checkpoint``.

    ``sink`` is the format that gets the changed keys of every batch, if someone wants them.
    """
    writer = newest_changes(changes).writeStream.format(sink).outputMode("update")
    with _rocksdb(changes.sparkSession):
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_keyed_state(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(space, id, status, ts) after the last committed batch, or after ``batch``."""
    fs, commits = file_system(spark, f"{checkpoint}/commits")
    if not fs.exists(commits) or not any(s.getPath().getName().isdigit() for s in fs.listStatus(commits)):
        return spark.createDataFrame([], STATE).select(*KEY, "status", "ts")
    reader = spark.read.format("statestore")
    if batch is not None:
        reader = reader.option("batchId", batch)
    state = reader.load(checkpoint)
    newest = state["value"].getField(state.schema["value"].dataType.names[0])  # the aggregation has one buffer
    return state.select(*(state["key"].getField(k).alias(k) for k in KEY), newest["status"].alias("status"), newest["ts"].alias("ts"))
