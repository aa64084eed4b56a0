"""Field-level fusion of place rows that stand for one place.

Rank order decides everything: the best-ranked row is the primary, each unknown field
takes the first known value.  Absorbed rows leave a tracer tag; tracers are a relation of
their own at any number, because a place with very many copies would need an array without
bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import text
from gleanery.schema import ORDER, ORDER_COLUMNS, PLACE, blank_to_null

# Source priority, best first; other sources come after these.
SOURCE_PRIORITY = ("google_places", "foursquare", "openstreetmap")
# Fields an absorbed row may fill in.
FILLED = (
    "neighborhood", "phone", "website", "google_maps_url", "cuisine", "rating",
    "review_count", "price_level", "opening_hours",
)
# What absorbed rows left on a place: first of those with its id (step 0), then of similar ones.
TRACER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("rank", T.StructType([T.StructField("priority", T.IntegerType()), *ORDER.fields])),
    ]
)


def priority_of(source: Column) -> Column:
    chain = F.when(source == SOURCE_PRIORITY[0], 0)
    for i, name in enumerate(SOURCE_PRIORITY[1:], 1):
        chain = chain.when(source == name, i)
    return chain.otherwise(len(SOURCE_PRIORITY))


def ranked(places: DataFrame) -> DataFrame:
    """Add ``rank``: source priority, then the order in which rows came in."""
    return places.withColumn(
        "rank", F.struct(priority_of(F.col("source")).alias("priority"), *ORDER_COLUMNS)
    )


def tracer_of(source: Column, source_id: Column) -> Column:
    return F.when(text(source_id) != "", F.concat(source, F.lit(":"), source_id)).otherwise(source)


def fuse(rows: DataFrame, group: str) -> DataFrame:
    """One row per group: the primary with its unknown fields filled in rank order.

    An aggregation with map-side combine; the group's rank is the primary's.
    """
    kinds = {f.name: f.dataType for f in PLACE.fields}
    kept = [c for c in PLACE.names if c not in FILLED and c != group]
    rank = F.col("rank")

    def first_known(name: str) -> Column:
        known = blank_to_null(F.col(name), kinds[name])
        return F.min_by(known, F.when(known.isNotNull(), rank)).alias(name)

    fused = rows.groupBy(group).agg(
        F.min_by(F.struct(*kept), rank).alias("_p"),
        *[first_known(c) for c in FILLED],
        F.min(rank).alias("rank"),
    )
    return fused.select(group, "_p.*", *FILLED, "rank")


def tracers(rows: DataFrame, group: str, primaries: DataFrame) -> DataFrame:
    """(group, tag, rank): what each absorbed row leaves on its primary, once.

    ``rows`` has group, rank, source, source_id; ``primaries`` group, rank.  Rows are told
    from primaries by group and rank together, so a large group is no hot key.
    """
    absorbed = rows.join(primaries.select(group, "rank"), [group, "rank"], "left_anti")
    tag = tracer_of(F.col("source"), F.col("source_id"))
    return absorbed.groupBy(group, tag.alias("tag")).agg(F.min("rank").alias("rank"))


def upsert_tracers(stored: DataFrame, found: DataFrame, places: DataFrame) -> DataFrame:
    """The next tracer relation (id, tag, step, rank): tags that came in replace a place's stored ones.

    ``places`` are the rows that came in; one without own tags and tracers leaves what is stored.
    """
    came = places.where(F.size("tags") > 0).select("id").unionByName(found.select("id")).distinct()
    return found.select(*TRACER.names).unionByName(stored.join(came, "id", "left_anti").select(*TRACER.names))


def all_tags(places: DataFrame, trace: DataFrame) -> DataFrame:
    """(id, tag) of places: their own tags and their tracers, each once."""
    own = places.select("id", F.explode("tags").alias("tag"))
    return own.unionByName(trace.join(places.select("id"), "id", "left_semi").select("id", "tag")).distinct()
