"""Whole runs: several kinds of sources over several days, from payloads to stored versions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.fusion import TRACER
from gleanery.plans.deltas import DeltaSnapshots
from gleanery.plans.places import places_job
from gleanery.plans.postings import postings_run
from gleanery.plans.snapshot import SnapshotTable, envelope, import_places, import_postings
from gleanery.schema import PLACE, POSTING, RAW, conform
from gleanery.session import Scratch, arrow_batches
from gleanery.settings import Preferences, Run
from gleanery.sources.places import DETAILS
from gleanery.sources.registry import Inputs
from workload.tables import RUN, table

QUERIES, ORACLE = {}, {}

# Days of the runs and which documents come in: every document on one day at least. A third each as payloads of a registered
# source, of a user-defined one, and as alert mails.
DAYS = ((0, "doc_id % 2 = 0"), (30, "doc_id % 5 <> 0"), (61, "doc_id % 7 = 0 or (doc_id % 2 <> 0 and doc_id % 5 = 0)"))
SOURCES = ("remotive", "generic", "nobody", "gmail_alerts", "himalayas")
PREFS = Preferences(strong=("Role",), sources=SOURCES)
_KIND = "doc_id % 3"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _day(ago: int) -> Run:
    return Run(RUN.at - timedelta(days=DAYS[-1][0] - ago))


def _payloads(docs: DataFrame, run: Run, ago: int) -> DataFrame:
    title = F.concat(F.lit("Role "), "doc_id", F.lit(f" day {ago}"))
    link = F.concat(F.lit("https://x.example/"), "doc_id")
    site = F.to_json(F.struct(F.array(F.struct(link.alias("url"), title.alias("title"), F.lit("C").alias("company_name"), F.col("text").alias("description"))).alias("jobs")))
    own = F.to_json(F.array(F.struct(link.alias("href"), title.alias("name"), F.col("text").alias("body"))))
    kind = F.expr(_KIND)
    rows = docs.where(kind < 2).select(
        F.when(kind == 0, "remotive").otherwise("own").alias("source"), kind.cast("int").alias("source_rank"), F.col("doc_id").alias("seq"),
        F.lit(run.at).cast("timestamp").alias("fetched_at"), F.when(kind == 0, site).otherwise(own).alias("payload"),
    )
    return conform(rows, RAW)


def _mails(docs: DataFrame, run: Run, ago: int) -> DataFrame:
    card = F.concat(
        F.lit("Content-Type: text/html; charset=utf-8\n\n<table><tr><td><a href='https://www.linkedin.com/jobs/view/"), "doc_id",
        F.lit("/?x=1'>Role "), "doc_id", F.lit(f" day {ago}</a></td></tr></table>"),
    )
    return docs.where(F.expr(_KIND) == 2).select(
        (F.col("doc_id") * 100 + ago).alias("uid"), F.lit("alerts@linkedin.com").alias("sender"), F.lit(run.day).alias("received"),
        F.lit(False).alias("seen"), card.alias("raw"),
    )


def _posted(spark: SparkSession, sf: str, by_delta: bool = False) -> tuple[SnapshotTable | DeltaSnapshots, DataFrame, DataFrame]:
    """The snapshot, the run log and the processed mails after all runs."""
    scratch = Scratch(spark, "days")
    root = scratch.path("snapshot")
    snapshots = DeltaSnapshots(spark, root, buckets=8, fold_ratio=4.0) if by_delta else SnapshotTable(spark, root, POSTING, buckets=8)
    log, processed = scratch.path("log"), scratch.path("processed")
    docs = table(spark, sf, "documents")
    definitions = [{"name": "own", "type": "json_api", "fields": {"url": "href", "title": "name", "description": "body"}}]
    mails, taken = None, None
    for ago, which in DAYS:
        run, some = _day(ago), docs.where(which)
        came = _mails(some, run, ago)
        mails = came if mails is None else mails.unionByName(came)  # the mailbox keeps older messages
        inputs = Inputs(scratch.save(_payloads(some, run, ago), "raw"), definitions, scratch.save(mails, "mail"), taken)
        postings_run(
            snapshots, inputs, PREFS, run, scratch, log_path=log,
            report_path=scratch.path("report"), processed_path=processed,
        )
        taken = spark.read.schema("uid long").parquet(processed)
    return snapshots, spark.read.parquet(log), taken


def _came(day: int) -> str:
    return f"({DAYS[day][1]})"


_LINK = (
    f"case {_KIND} when 2 then 'https://www.linkedin.com/jobs/view/' || doc_id || '/' else 'https://x.example/' || doc_id end"
)
_LAST = f"case when {_came(2)} then {DAYS[2][0]} else {DAYS[1][0]} end"


@query(
    f"""select {_LINK} as url, 'Role ' || doc_id || ' day ' || {_LAST} as title,
    case {_KIND} when 0 then 'remotive' when 1 then 'own' else 'linkedin' end as source,
    case when {_came(1)} then '{_day(DAYS[1][0]).day}' else '{_day(DAYS[2][0]).day}' end as first_seen
    from documents where not {_came(0)} and ({_came(1)} or {_came(2)})"""
)
def postings_run_rows(spark, sf):
    """What three runs leave: rows first seen on the first day are past their time on the last."""
    snapshots, *_ = _posted(spark, sf)
    return snapshots.read().select("url", "title", "source", F.col("first_seen").cast("string").alias("first_seen"))


@query(ORACLE["postings_run_rows"])
def postings_delta_rows(spark, sf):
    """The same runs, each of which appends its batch: the second and third are merged on reading."""
    snapshots, *_ = _posted(spark, sf, by_delta=True)
    rows = snapshots.read(PREFS, _day(DAYS[-1][0]))
    return rows.select("url", "title", "source", F.col("first_seen").cast("string").alias("first_seen"))


_COUNTS = " union all ".join(
    f"select '{_day(ago).day}' as day, '{name}' as source, count(*) filter ({_KIND} = {kind} and ({which})) as n from documents"
    for ago, which in DAYS
    for name, kind in (("remotive", 0), ("generic", 1), ("gmail_alerts", 2), ("himalayas", 9))
)


@query(_COUNTS)
def postings_run_log(spark, sf):
    """Rows per enabled source and run; a mail that gave a posting is not read again."""
    _, log, _ = _posted(spark, sf)
    return log.select(F.col("run_ts").cast("date").cast("string").alias("day"), "source", "n")


@query(
    f"""select '{_day(DAYS[2][0]).day}' as day, (select count(*) from documents where not {_came(0)} and ({_came(1)} or {_came(2)})) as count,
    count(*) filter ({_KIND} = 2 and {_came(2)}) as mails, (select sum((({_KIND} = 2) and {_came(0)})::int + (({_KIND} = 2) and {_came(1)})::int
    + (({_KIND} = 2) and {_came(2)})::int)::bigint from documents) as processed from documents"""
)
def postings_run_envelope(spark, sf):
    snapshots, log, processed = _posted(spark, sf)
    told = envelope(log, snapshots.read())
    return told.select(
        F.col("checked_at").cast("date").cast("string").alias("day"), "count", F.col("counts")["gmail_alerts"].alias("mails"),
        processed.agg(F.count("*")).scalar().alias("processed"),
    )


_VENUE = "(p_partkey % 5 = 0 or (p_partkey % 2 <> 0 and p_partkey % 3 <> 0))"  # also what no other service has


def _place_payloads(spark, sf) -> DataFrame:
    """Parts as search results with details, map elements and venues of three services."""
    part = table(spark, sf, "part")
    name = F.md5(F.col("p_partkey").cast("string"))
    at = F.lit(RUN.at).cast("timestamp")
    search = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("g"), "p_partkey").alias("place_id"), name.alias("name"),
                                                F.lit("street").alias("formatted_address"))).alias("results")))
    detail = F.to_json(F.struct(F.struct(F.concat(F.lit("g"), "p_partkey").alias("place_id"), name.alias("name"),
                                         F.lit("street").alias("formatted_address"), F.concat(F.lit("w"), "p_partkey").alias("website")).alias("result")))
    element = F.to_json(F.struct(F.array(F.struct(F.lit("node").alias("type"), F.col("p_partkey").alias("id"), F.create_map(
        F.lit("name"), name, F.lit("addr:city"), F.lit("street"), F.lit("phone"), F.concat(F.lit("p"), "p_partkey")).alias("tags"))).alias("elements")))
    venue = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("f"), "p_partkey").alias("fsq_id"), F.md5(F.concat(F.lit("f"), "p_partkey")).alias("name"),
                                                F.struct(F.lit("road").alias("address")).alias("location"), F.lit(8.5).alias("rating"))).alias("results")))
    parts = (
        ("google_places", search, "p_partkey % 2 = 0"), ("google_places" + DETAILS, detail, "p_partkey % 4 = 0"),
        ("openstreetmap", element, "p_partkey % 3 = 0"), ("foursquare", venue, _VENUE),
    )
    out = None
    for rank, (source, payload, which) in enumerate(parts):
        rows = part.where(which).select(
            F.lit(source).alias("source"), F.lit(rank).alias("source_rank"), F.col("p_partkey").alias("seq"), at.alias("fetched_at"), payload.alias("payload")
        )
        out = rows if out is None else out.unionByName(rows)
    return conform(out, RAW)


_PLACED = f"""
with g as (select p_partkey, case when p_partkey % 4 = 0 then 'w' || p_partkey end as website,
    case when p_partkey % 3 = 0 then 'p' || p_partkey end as phone, case when p_partkey % 3 = 0 then 1 else 0 end as tracers
  from part where p_partkey % 2 = 0),
o as (select p_partkey from part where p_partkey % 3 = 0 and p_partkey % 2 <> 0),
f as (select p_partkey from part where {_VENUE})
select 'google_places' as source, 'g' || p_partkey as source_id, website, phone, cast(null as double) as rating, tracers::bigint as tracers from g
union all select 'openstreetmap', 'node/' || p_partkey, null, 'p' || p_partkey, null, 0 from o
union all select 'foursquare', 'f' || p_partkey, null, null, 4.2, 0 from f"""


@query(_PLACED)
def places_run_rows(spark, sf):
    """Two runs over three services: one place by two of them is one row with a tracer.

    The second run is no bulk run: a service that takes part in bulk runs only is not asked, and
    what it gave before stays."""
    scratch = Scratch(spark, "places")
    places = SnapshotTable(spark, scratch.path("places"), PLACE, buckets=4)
    traces = SnapshotTable(spark, scratch.path("tracers"), TRACER, buckets=4)
    raw = scratch.save(_place_payloads(spark, sf), "raw")
    names = ("google_places", "nobody", "openstreetmap", "foursquare")
    for mode in ("bulk", "daily"):
        places_job(places, traces, raw, names, RUN, scratch, mode)
    left = traces.read(1).groupBy("id").agg(F.count("*").alias("tracers"))
    return places.read(2).join(left, "id", "left").select(
        "source", "source_id", "website", "phone", "rating", F.coalesce("tracers", F.lit(0)).cast("long").alias("tracers")
    )


def _json_documents(items: DataFrame, path: str, key: str | None) -> str:
    """One JSON document per partition below ``path``: an array of the items, under ``key`` if there is one."""
    opening, closing = (f"{{{json.dumps(key)}: [", "]}") if key else ("[", "]")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = opening
        for batch in batches:
            out = []
            for item in batch.column("item").to_pylist():
                out.append(before + item)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([closing if before == "," else before + closing])], ["value"])

    with arrow_batches(items.sparkSession):
        items.select(F.to_json(F.struct("*")).alias("item")).mapInArrow(lines, "value string").write.text(path)
    return path


_IMPORTED = f"""select 'x' || doc_id as id, 'Role ' || doc_id || ' again' as title, coalesce(text, '') as description, 'new' as status,
    0::bigint as score, '{RUN.day}' as first_seen, case when doc_id % 2 = 0 then coalesce(lang, '') else '' end as location from documents"""


def _imported(spark, sf, key):
    """Every document twice in a stored JSON snapshot; the later one of an id wins, what it lacks is filled in."""
    scratch = Scratch(spark, "import")
    both = table(spark, sf, "documents").withColumn("again", F.explode(F.array(F.lit(""), F.lit(" again"))))
    items = both.select(
        F.concat(F.lit("x"), "doc_id").alias("id"), F.concat(F.lit("Role "), "doc_id", "again").alias("title"), F.lit("C").alias("company"),
        F.concat(F.lit("https://x.example/"), "doc_id").alias("url"), F.lit("own").alias("source"), F.col("text").alias("description"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("location"), F.when(F.col("again") == "", "saved").otherwise("").alias("status"),
    )
    rows = import_postings(spark, _json_documents(items, scratch.path("snapshot"), key), RUN)
    return rows.select(
        "id", "title", "description", "status", F.col("score").cast("long").alias("score"), F.col("first_seen").cast("string").alias("first_seen"), "location"
    )


@query(_IMPORTED)
def postings_import_envelope(spark, sf):
    return _imported(spark, sf, "jobs")


@query(_IMPORTED)
def postings_import_array(spark, sf):
    return _imported(spark, sf, None)


@query(
    f"""select 'p' || p_partkey as id, p_name as name, case when p_partkey % 3 = 0 then 'visited' else 'new' end as status,
    '{RUN.day}' as first_seen, '{RUN.day}' as last_updated, case when p_partkey % 2 = 0 then p_retailprice::double end as rating from part"""
)
def places_import(spark, sf):
    """Parts as a stored JSON snapshot of places; status and rating are given for some."""
    key = F.col("p_partkey")
    items = table(spark, sf, "part").select(
        F.concat(F.lit("p"), key).alias("id"), F.col("p_name").alias("name"), F.lit("own").alias("source"),
        F.when(key % 3 == 0, "visited").alias("status"), F.when(key % 2 == 0, F.col("p_retailprice").cast("double")).alias("rating"),
    )
    rows = import_places(spark, _json_documents(items, Scratch(spark, "import").path("snapshot"), "restaurants"), RUN)
    return rows.select(
        "id", "name", "status", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_updated").cast("string").alias("last_updated"), "rating"
    )
