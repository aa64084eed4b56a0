"""Payloads as a stream: a log of folded micro-batches, merged with a snapshot on reading.

A micro-batch writes one row per posting that came in, so its cost does not grow with what
is stored.  Version ``n`` of the snapshot covers the batches below ``n``; ``compact`` writes
one from time to time.  Directories are named by the batch id and overwritten whole when a
batch is repeated, so each payload counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators.retention import RETENTION_DAYS, retain
from gleanery.operators.upsert import fold_postings
from gleanery.plans.postings import next_snapshot
from gleanery.plans.snapshot import SnapshotTable
from gleanery.schema import ORDER_COLUMNS, POSTING
from gleanery.settings import Preferences, Run
from gleanery.sources.landing import POSTING_ROWS
from gleanery.sources.registry import read_sources
from gleanery.streaming.states import complete

_LOGGED = T.StructType([*POSTING_ROWS.fields, T.StructField("batch", T.IntegerType())])

def start_ingest(
    payloads: DataFrame,
    log: str,
    prefs: Preferences,
    checkpoint: str,
    run_of: Callable[[int], Run],
    read: Callable[[DataFrame, Run], DataFrame] | None = None,
    **trigger,
) -> StreamingQuery:
    """``payloads`` is a stream of landing rows, ``run_of`` gives a batch its instant.

    ``read`` turns payloads into postings; by default the enabled registered sources do.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch_id)
        rows = read(batch, run) if read else read_sources(prefs.sources, batch, run)
        folded = fold_postings(rows).select(*POSTING.names, *ORDER_COLUMNS)
        folded.write.mode("overwrite").parquet(f"{log}/batch={batch_id:012d}")

    writer = payloads.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def pending(snapshots: SnapshotTable, log: str) -> tuple[list[int], DataFrame]:
    """Numbers of the batches that no version covers yet, and their rows folded to one per id."""
    spark, covered = snapshots.spark, snapshots.latest() or 0
    numbers = [n for n in complete(spark, log, "batch") if n >= covered]
    rows = spark.createDataFrame([], POSTING_ROWS).withColumn("batch", F.lit(0))
    if numbers:
        paths = [f"{log}/batch={n:012d}" for n in numbers]
        rows = spark.read.schema(_LOGGED).option("basePath", log).parquet(*paths)
    return numbers, fold_postings(rows, F.struct("batch", *ORDER_COLUMNS)).drop("batch")


def read_postings(snapshots: SnapshotTable, log: str, prefs: Preferences, run: Run) -> DataFrame:
    """Everything that came in so far, scored: the last version merged with the pending batches."""
    before = snapshots.latest()
    _, folded = pending(snapshots, log)
    return next_snapshot(snapshots.read(before), folded, prefs, run, buckets=snapshots.buckets_of(before))


def compact(
    snapshots: SnapshotTable, log: str, prefs: Preferences, run: Run, retention_days: int | None = RETENTION_DAYS
) -> int | None:
    """Write a version that covers all complete batches; returns its number (None: nothing came in)."""
    numbers, _ = pending(snapshots, log)
    if not numbers:
        return snapshots.latest()
    layout = snapshots.buckets_of(snapshots.latest())
    rows = read_postings(snapshots, log, prefs, run)
    kept = rows if retention_days is None else retain(rows, run.day, retention_days)
    return snapshots.write(kept, numbers[-1] + 1, clustered=layout)
