"""Status changes and payload ingest: as a batch and as file streams over ``events``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import variants as V
from gleanery.operators.state import latest_state, merge_state
from gleanery.plans.snapshot import SnapshotTable
from gleanery.schema import POSTING, STATE
from gleanery.session import Scratch
from gleanery.sources.landing import finish_postings
from gleanery.streaming.ingest import compact as compact_postings
from gleanery.streaming.ingest import read_postings, start_ingest
from gleanery.streaming.keyed import read_keyed_state, start_keyed_state
from gleanery.streaming.states import LOGGED, read_state, start_state_log
from gleanery.streaming.states import compact as compact_states
from workload.tables import PREFS, RUN, table

QUERIES, ORACLE = {}, {}
EPOCH = datetime(1970, 1, 1)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _changes(events: DataFrame) -> DataFrame:
    """A user's status per event type; hours as time, so that many changes are equal."""
    return events.select(
        F.col("user_id").cast("string").alias("space"), F.col("event_type").alias("id"),
        F.col("value").cast("string").alias("status"),
        F.timestamp_diff("HOUR", F.lit(EPOCH).cast("timestamp_ntz"), "ts").alias("ts"), F.col("event_id").alias("arrival"),
    )


_CHANGES = """(select cast(user_id as varchar) as space, event_type as id, cast(value as varchar) as status,
  cast(floor(epoch(ts) / 3600) as bigint) as ts, event_id as arrival from events)"""
_LATEST = f"""select space, id, status, ts from (select *, row_number() over
  (partition by space, id order by ts desc, arrival) as rn from {_CHANGES}) where rn = 1"""


@query(_LATEST)
def lww_state(spark: SparkSession, sf: str) -> DataFrame:
    return latest_state(_changes(table(spark, sf, "events"))).select("space", "id", "status", "ts")


@query(_LATEST)
def lww_merge(spark, sf):
    """The earlier half is the stored state, the later half the changes."""
    changes = _changes(table(spark, sf, "events"))
    half = "arrival < (select count(*) / 2 from {e})"
    first = spark.sql("select * from {c} where " + half, c=changes, e=changes)
    second = spark.sql("select * from {c} where not (" + half + ")", c=changes, e=changes)
    stored = latest_state(first).select(*STATE.names)
    return merge_state(stored, second)


PARTS = 4


def _arriving(spark, sf, job: str) -> tuple[DataFrame, Scratch, Callable[[int], None]]:
    """A stream over a folder, and what puts the n-th part of the events into it, in event order."""
    scratch = Scratch(spark, job)
    events = table(spark, sf, "events")
    folder = scratch.path("events")
    low, high = (n or 0 for n in events.agg(F.min("event_id"), F.max("event_id")).first())
    step = (high - low) // PARTS + 1

    def arrive(n: int) -> None:
        begin = low + n * step
        events.where(F.col("event_id").between(begin, begin + step - 1)).write.mode("append").parquet(folder)

    arrive(0)
    return spark.readStream.schema(events.schema).parquet(folder), scratch, arrive


@query(_LATEST)
def lww_stream(spark, sf):
    """One batch per part of the events; the log is compacted on the way, its last batch repeated."""
    stream, scratch, arrive = _arriving(spark, sf, "states")
    log, checkpoint = scratch.path("log"), scratch.path("checkpoint")
    for n in range(PARTS):
        if n:
            arrive(n)
        start_state_log(_changes(stream), log, checkpoint).awaitTermination()
        if n == 1:
            compact_states(spark, log)
    again = spark.read.schema(LOGGED).parquet(f"{log}/batch={1:012d}")
    again.write.parquet(f"{log}/batch={PARTS:012d}")  # covered by the base, and now once more
    return read_state(spark, log)


@query(_LATEST)
def lww_operator_state(spark, sf):
    """The same batches folded into the state of one aggregation; every part is a restart from its checkpoint."""
    stream, scratch, arrive = _arriving(spark, sf, "keyed")
    checkpoint = scratch.path("checkpoint")
    for n in range(PARTS):
        if n:
            arrive(n)
        start_keyed_state(_changes(stream), checkpoint).awaitTermination()
    return read_keyed_state(spark, checkpoint)


@query(
    """select 'https://x/' || user_id || '/' || event_type as url, arg_max(k, event_id) as title, count(*) > 0 as known
    from (select *, json_extract_string(props, '$.k') as k from events) group by user_id, event_type"""
)
def ingest_stream(spark, sf):
    """Events as landing payloads, one batch per part: each (user, type) is one posting, the
    last event wins.  Two batches are compacted into a version, two are merged on reading."""
    stream, scratch, arrive = _arriving(spark, sf, "ingest")
    link = F.concat(F.lit("https://x/"), "user_id", F.lit("/"), "event_type")
    raw = stream.select(
        F.lit("feed").alias("source"), F.lit(0).alias("source_rank"), F.col("event_id").alias("seq"),
        F.col("ts").alias("fetched_at"),
        F.to_json(F.struct(link.alias("url"), "props")).alias("payload"),
    )

    def read(batch, run):
        value = V.parse(F.col("payload"))
        rows = batch.select(
            "source", "source_rank", "seq", F.array(F.lit(0)).alias("pos"),
            V.field(value, "url").alias("url"),
            V.field(V.parse(V.field(value, "props")), "k").alias("title"),
        )
        return finish_postings(rows, run, distinct_urls=False)

    snapshots = SnapshotTable(spark, scratch.path("snapshot"), POSTING, buckets=8)
    log, checkpoint = scratch.path("log"), scratch.path("checkpoint")
    for n in range(PARTS):
        if n:
            arrive(n)
        start_ingest(raw, log, PREFS, checkpoint, lambda _: RUN, read).awaitTermination()
        if n == 1:
            compact_postings(snapshots, log, PREFS, RUN, retention_days=None)
    return read_postings(snapshots, log, PREFS, RUN).select("url", "title", F.lit(True).alias("known"))
