"""Keyed upserts of a batch into a stored snapshot.

A batch is folded to one row per id first.  The fold is an aggregation, so it combines
map-side and a hot id costs one row per task in the shuffle.  Both join sides are then
unique by id, which leaves the join without skew.  Against a snapshot bucketed by id
(``plans.snapshot``) only the batch is shuffled.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.schema import PLACE, POSTING, batch_order

# Place fields an incoming row may overwrite.
OVERWRITTEN = (
    "name", "address", "neighborhood", "cuisine", "price_level", "rating", "review_count",
    "phone", "website", "google_maps_url", "opening_hours", "photos", "tags",
)


def _latest(column: Column, order: Column) -> Column:
    """The last non-null value in batch order (``max_by`` alone would keep a null)."""
    return F.max_by(column, F.when(column.isNotNull(), order))


def _earliest(column: Column, order: Column) -> Column:
    return F.min_by(column, F.when(column.isNotNull(), order))


def side_by_side(
    snapshot: DataFrame, folded: DataFrame, buckets: int | None
) -> tuple[DataFrame, Column, Column]:
    """Stored and incoming rows by id, and whether each side has the row.

    ``buckets`` of a bucketed snapshot: the batch is laid out likewise, else the planner
    could shuffle the stored side to the batch's number of partitions.
    """
    if buckets:
        folded = folded.repartition(buckets, "id")
    stored = snapshot.withColumn("_here", F.lit(True)).alias("s")
    coming = folded.withColumn("_here", F.lit(True)).alias("b")
    both = stored.join(coming, "id", "full_outer")
    return both, F.col("b._here").isNotNull(), F.col("s._here").isNotNull()


def fold_postings(batch: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per id: the last row, the first ``first_seen``, the first set status.

    ``order`` is a struct of columns, by default the batch's own; they come out as columns.
    """
    order = batch_order() if order is None else order
    plain = [c for c in POSTING.names if c not in ("id", "first_seen", "status")]
    own = F.when(F.col("status") != "new", F.col("status"))
    folded = batch.groupBy("id").agg(
        F.max_by(F.struct(*plain), order).alias("_last"),
        F.min_by("first_seen", order).alias("first_seen"),
        F.coalesce(_earliest(own, order), F.lit("new")).alias("status"),
        F.min(order).alias("_order"),
    )
    return folded.select("id", "_last.*", "first_seen", "status", "_order.*")


def upsert_postings(snapshot: DataFrame, batch: DataFrame, buckets: int | None = None) -> DataFrame:
    """Incoming rows replace stored ones, which keep ``first_seen`` and a set status.

    Adds ``is_new`` and the batch order of the rows that came in.
    """
    return merge_folded_postings(snapshot, fold_postings(batch), buckets)


def merge_folded_postings(
    snapshot: DataFrame, folded: DataFrame, buckets: int | None = None
) -> DataFrame:
    both, came, stored = side_by_side(snapshot, folded, buckets)
    replaced = [
        F.when(came, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
        for c in POSTING.names
        if c not in ("id", "first_seen", "status")
    ]
    status = F.when(F.col("s.status") != "new", F.col("s.status"))
    return both.select(
        "id",
        *replaced,
        F.when(stored, F.col("s.first_seen")).otherwise(F.col("b.first_seen")).alias("first_seen"),
        F.coalesce(status, F.col("b.status"), F.col("s.status")).alias("status"),
        (came & ~stored).alias("is_new"),
        *[F.col(f"b.{c}") for c in ("source_rank", "seq", "pos")],
    )


def fold_places(batch: DataFrame, run_day: date) -> DataFrame:
    """One row per id: listed fields take their last known value, the rest the first row's."""
    order = batch_order()
    kept = [c for c in PLACE.names if c not in ("id", "last_updated", *OVERWRITTEN)]
    folded = batch.groupBy("id").agg(
        F.min_by(F.struct(*kept, "last_updated"), order).alias("_first"),
        *[_latest(F.col(c), order).alias(c) for c in OVERWRITTEN],
        F.count("*").alias("_rows"),
        F.min(order).alias("_order"),
    )
    updated = F.when(F.col("_rows") > 1, F.lit(run_day)).otherwise(F.col("_first.last_updated"))
    return folded.select(
        "id", *OVERWRITTEN, *[F.col(f"_first.{c}") for c in kept],
        updated.alias("last_updated"), "_order.*",
    )


def upsert_places(
    snapshot: DataFrame, batch: DataFrame, run_day: date, buckets: int | None = None
) -> DataFrame:
    """Known incoming values overwrite the listed fields, unknown ones do not."""
    both, came, stored = side_by_side(snapshot, fold_places(batch, run_day), buckets)
    fields = [
        F.coalesce(F.col(f"b.{c}"), F.col(f"s.{c}")).alias(c)
        if c in OVERWRITTEN
        else F.when(stored, F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
        for c in PLACE.names
        if c not in ("id", "last_updated")
    ]
    updated = (
        F.when(came & stored, F.lit(run_day))
        .when(stored, F.col("s.last_updated"))
        .otherwise(F.col("b.last_updated"))
    )
    return both.select("id", *fields, updated.alias("last_updated"), (came & ~stored).alias("is_new"))


def new_rows(batch: DataFrame, snapshot: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the batch whose key is not stored yet; the snapshot scan reads the key only."""
    return batch.join(snapshot.select(key), key, "left_anti")
