"""Place runs: resolve duplicates across sources, then upsert the snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import match_key, text
from gleanery.operators.fusion import all_tags, fuse, ranked, tracers, upsert_tracers
from gleanery.operators.health import ranked_names, rows_per_source, source_counts
from gleanery.operators.leaders import assign_leaders, rank_keys
from gleanery.operators.similarity import THRESHOLD
from gleanery.operators.upsert import upsert_places
from gleanery.plans.snapshot import SnapshotTable, log_run
from gleanery.schema import ORDER_COLUMNS, PLACE
from gleanery.session import Scratch
from gleanery.settings import Run
from gleanery.sources.places import PLACE_SOURCES, read_places


@dataclass
class Resolved:
    """``places`` is one row per place (with its rank and own tags), ``tracers`` (id, tag, step, rank),
    ``groups`` (id, leader_id) of every row that had a distinct id."""

    places: DataFrame
    tracers: DataFrame
    groups: DataFrame

    def tags(self) -> DataFrame:
        return all_tags(self.places, self.tracers)


def place_key(name, address):
    return match_key(F.concat(text(name), F.lit(" "), text(address)))


def fuse_by_id(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with one id to one row, and the tracers of the absorbed rows."""
    ordered = ranked(rows)
    fused = fuse(ordered, "id")
    return fused, tracers(ordered.select("id", "rank", "source", "source_id"), "id", fused)


def resolve(rows: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> Resolved:
    """Exact ids first, then similar name and address, in rank order."""
    fused, id_trace = fuse_by_id(rows)
    fused = scratch.save(fused, "by_id")
    id_trace = scratch.save(id_trace, "id_tracers")
    key = place_key(F.col("name"), F.col("address"))
    keyed = scratch.save(fused.select("id", key.alias("key"), "rank"), "keyed")
    keys = rank_keys(keyed, scratch)
    leads = assign_leaders(keys.select("kid", "key"), scratch, threshold)
    # the leader of a key, as the id of the best-ranked row that has the leader's key
    first_id = keyed.groupBy("key").agg(F.min_by("id", "rank").alias("leader_id"))
    leader_ids = keys.join(first_id, "key").select(F.col("kid").alias("leader"), "leader_id")
    groups = scratch.save(
        keyed.join(keys.select("kid", "key"), "key")
        .join(leads, "kid")
        .join(leader_ids, "leader")
        .select("id", "leader_id"),
        "groups",
    )
    members = fused.join(groups, "id")
    # the id is a field of the group here; a group's row keeps its primary's id
    places = fuse(members, "leader_id").drop("leader_id")
    absorbed = tracers(
        members.select("leader_id", "rank", "source", "source_id"),
        "leader_id",
        places.select(F.col("id").alias("leader_id"), "rank"),
    )
    own = id_trace.join(groups.where(F.col("id") == F.col("leader_id")).select("id"), "id", "left_semi")
    both = own.withColumn("step", F.lit(0)).unionByName(
        absorbed.withColumnRenamed("leader_id", "id").withColumn("step", F.lit(1))
    )
    trace = both.groupBy("id", "tag").agg(F.min(F.struct("step", "rank")).alias("_at")).select("id", "tag", "_at.*")
    return Resolved(scratch.save(places, "places"), scratch.save(trace, "tracers"), groups)


@dataclass
class PlacesRun:
    """``places`` is the next snapshot (with ``is_new``), ``tracers`` the next tracer relation."""

    places: DataFrame
    tracers: DataFrame
    found: Resolved


def places_run(
    snapshot: DataFrame,
    trace: DataFrame,
    rows: DataFrame,
    run: Run,
    scratch: Scratch,
    threshold: float = THRESHOLD,
    buckets: int | None = None,
) -> PlacesRun:
    """The next snapshot and tracers from the stored ones and the fetched rows."""
    found = resolve(rows, scratch, threshold)
    incoming = found.places.select(*PLACE.names, *[F.col(f"rank.{c}") for c in ORDER_COLUMNS])
    places = upsert_places(snapshot, incoming, run.day, buckets)
    return PlacesRun(places, upsert_tracers(trace, found.tracers, incoming), found)


@dataclass
class PlacesJob:
    version: int
    counts: DataFrame  # (name, rank, n) of every enabled source somebody can read
    unknown: list[str]


def places_job(
    snapshots: SnapshotTable,
    traces: SnapshotTable,
    raw: DataFrame,
    names: Sequence[str],
    run: Run,
    scratch: Scratch,
    mode: str = "bulk",
    log_path: str | None = None,
    version: int | None = None,
) -> PlacesJob:
    """From payloads to written versions of the places and of their tracers.

    The tracers are written first, under the number of the places' version that they
    belong to, so a version of places always has its tracers.  A run that failed between the two
    leaves tracers without places: its number is not used again, and if it is asked for, the
    tracers are written anew.
    """
    known = [n for n in names if n in PLACE_SOURCES]
    rows = scratch.save(read_places(known, raw, run, mode), "rows")
    counts = scratch.save(source_counts(ranked_names(raw.sparkSession, known), rows_per_source(rows)), "counts")
    before = snapshots.latest(version)
    version = max(before or 0, traces.latest() or 0) + 1 if version is None else version
    stored = snapshots.read(before) if before is not None else snapshots.empty()
    trace = traces.read(before) if before is not None else traces.empty()
    layout = snapshots.buckets_of(before)
    done = places_run(stored, trace, rows, run, scratch, buckets=layout)
    traces.write(done.tracers, version, again=version not in snapshots.versions())
    snapshots.write(done.places, version, clustered=layout)
    if log_path:
        log_run(counts, log_path, run, version)
    return PlacesJob(version, counts, [n for n in names if n not in known])
