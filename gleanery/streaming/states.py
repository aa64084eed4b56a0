"""Status changes as a stream: a log of reduced micro-batches and its latest view.

A micro-batch writes only its own newest change per key, so its cost does not grow with
the stored state.  The directory is named by the batch id and overwritten whole when a
batch is repeated, so each change counts once.  Reading takes the newest change over the
log; ``compact`` folds the batches so far into a base from time to time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators.state import KEY, latest_state
from gleanery.schema import STATE
from gleanery.session import file_system

LOGGED = T.StructType([*STATE.fields, T.StructField("arrival", T.LongType())])


def start_state_log(changes: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """``changes`` is a stream of (space, id, status, ts, arrival)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest_state(batch).select(*LOGGED.names)
        newest.write.mode("overwrite").parquet(f"{root}/batch={batch_id:012d}")

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def complete(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the complete directories ``<kind>=<number>`` of a log."""
    fs, path = file_system(spark, root)
    if not fs.exists(path):
        return []
    jvm, found = spark._jvm, []
    for status in fs.listStatus(path):
        name, _, number = status.getPath().getName().partition("=")
        if name == kind and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(number))
    return sorted(found)


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """(space, id, status, ts): the newest change of every key.

    Batches arrive in batch order, so the arrival of a change is (batch, arrival).  The
    last base stands for all batches up to the one it is named by.
    """
    schema = T.StructType([*LOGGED.fields, T.StructField("batch", T.LongType())])
    bases = complete(spark, root, "base")
    covered = bases[-1] if bases else -1
    paths = [f"{root}/batch={n:012d}" for n in complete(spark, root, "batch") if n > covered]
    log = spark.createDataFrame([], schema)
    if paths:
        log = spark.read.schema(schema).option("basePath", root).parquet(*paths)
    if bases:
        base = spark.read.schema(LOGGED).parquet(f"{root}/base={covered:012d}")
        log = log.unionByName(base.withColumn("batch", F.lit(covered).cast("long")))
    value = F.struct("status", "ts")
    first_of_equals = F.struct("ts", (-F.col("batch")).alias("b"), (-F.col("arrival")).alias("a"))
    return log.groupBy(*KEY).agg(F.max_by(value, first_of_equals).alias("_v")).select(*KEY, "_v.*")


def compact(spark: SparkSession, root: str) -> int | None:
    """Fold all complete batches into a base, next to them: a running stream goes on with
    its own numbers, and a batch that is repeated later is covered.  Returns the last
    batch that the base covers."""
    batches, bases = complete(spark, root, "batch"), complete(spark, root, "base")
    if not batches or (bases and bases[-1] >= batches[-1]):
        return bases[-1] if bases else None
    state = read_state(spark, root).withColumn("arrival", F.lit(-1).cast("long"))
    state.select(*LOGGED.names).write.mode("overwrite").parquet(f"{root}/base={batches[-1]:012d}")
    return batches[-1]
