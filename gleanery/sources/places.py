"""Place payloads of three services to canonical place rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.ids import place_id
from gleanery.functions.listing import (
    cuisine_from_list,
    cuisine_from_types,
    halved_rating,
    neighborhood_of,
)
from gleanery.functions.text import or_default, strip, text
from gleanery.operators.order import first_wins_wide
from gleanery.schema import HOURS, ORDER, ORDER_COLUMNS, PLACE, conform, places_with_nulls
from gleanery.settings import Run
from gleanery.sources.landing import explode_items, rejects

PLACE_ROWS = T.StructType(PLACE.fields + ORDER.fields)

_GOOGLE = (
    "struct<place_id:string,name:string,formatted_address:string,"
    "address_components:array<struct<long_name:string,types:array<string>>>,types:array<string>,"
    "rating:double,user_ratings_total:int,price_level:int,formatted_phone_number:string,"
    "website:string,opening_hours:struct<weekday_text:array<string>,open_now:boolean>,"
    "photos:array<struct<photo_reference:string>>,permanently_closed:boolean>"
)
PHOTO_URL = "https://maps.googleapis.com/maps/api/place/photo?maxwidth=400&photoreference="
MAPS_URL = "https://www.google.com/maps/place/?q=place_id:"
VENUE_URL = "https://foursquare.com/v/"
DEFAULT_CITY = "Praha"
DETAILS = "/details"
# Fixed value: sources that a run of another mode does not ask.
BULK_ONLY = frozenset(("openstreetmap",))


def finish_places(rows: DataFrame, run: Run) -> DataFrame:
    """Validity, id and dates; blanks become null."""
    filled = rows.where(text(F.col("name")) != "").withColumns(
        {
            "id": place_id(F.col("source_id"), F.col("name"), F.col("address")),
            "first_seen": F.lit(run.day),
            "last_updated": F.lit(run.day),
            "status": F.lit("new"),
        }
    )
    return places_with_nulls(conform(filled, PLACE_ROWS))


def place_rejects(rows: DataFrame, closed: Column | None = None) -> DataFrame:
    """(source, seq, reason) of unfinished rows that are left out: closed for good, or without a name."""
    gone = F.lit(False) if closed is None else F.coalesce(closed, F.lit(False))
    return rejects(rows, F.when(gone, "closed").when(text(F.col("name")) == "", "no name"))


def read_places(names: Sequence[str], raw: DataFrame, run: Run, mode: str = "bulk") -> DataFrame:
    """All place rows of the enabled sources; some contribute to bulk runs only.

    Detail records lie in the landing table under their source's name and ``DETAILS``.
    """
    parts = [
        PLACE_SOURCES[n](raw, run).select(*PLACE_ROWS.names)
        for n in names
        if n in PLACE_SOURCES and (mode == "bulk" or n not in BULK_ONLY)
    ]
    out = raw.sparkSession.createDataFrame([], PLACE_ROWS) if not parts else parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _hours(weekday: Column | None = None, open_now: Column | None = None, raw: Column | None = None) -> Column:
    given = {"weekday_text": weekday, "open_now": open_now, "raw": raw}
    return F.struct(
        *[
            (F.lit(None) if given[f.name] is None else given[f.name]).cast(f.dataType).alias(f.name)
            for f in HOURS.fields
        ]
    )


def google_search(raw: DataFrame) -> DataFrame:
    """Search results of all queries, one row per place id, the first one found."""
    parsed = raw.withColumn("_r", F.from_json("payload", f"results array<{_GOOGLE}>"))
    rows = explode_items(parsed, F.col("_r")["results"], "found").drop("_r")
    rows = rows.withColumn("place_id", F.col("found.place_id")).where(text(F.col("place_id")) != "")
    return first_wins_wide(rows, ["source", "place_id"], ORDER_COLUMNS, "place_id")


def google_details(raw: DataFrame) -> DataFrame:
    """(place_id, detail) from detail payloads."""
    parsed = raw.select(F.from_json("payload", f"result {_GOOGLE}")["result"].alias("detail"), "source", "seq")
    keyed = parsed.withColumn("place_id", F.col("detail.place_id")).where(text(F.col("place_id")) != "")
    return first_wins_wide(keyed, ["place_id"], ["seq"], "place_id").select("place_id", "detail")


def google_places(search: DataFrame, details: DataFrame, run: Run) -> DataFrame:
    """Search results with their details; a found detail record replaces the search one."""
    rows = google_rows(search, details)
    return finish_places(rows.where(~F.coalesce("closed", F.lit(False))), run)


def google_rows(search: DataFrame, details: DataFrame) -> DataFrame:
    """Unfinished place rows, with whether a place is closed for good."""
    both = google_search(search).join(google_details(details), "place_id", "left")
    return both.withColumn("p", F.coalesce("detail", "found")).select(
        "source", *ORDER_COLUMNS,
        strip(F.col("p.name")).alias("name"),
        F.coalesce("p.formatted_address", "found.formatted_address", F.lit("")).alias("address"),
        F.col("place_id").alias("source_id"),
        neighborhood_of(F.col("p.address_components")).alias("neighborhood"),
        cuisine_from_types(F.col("p.types")).alias("cuisine"),
        F.col("p.rating").alias("rating"),
        F.col("p.user_ratings_total").alias("review_count"),
        F.col("p.price_level").alias("price_level"),
        F.col("p.formatted_phone_number").alias("phone"),
        F.col("p.website").alias("website"),
        F.concat(F.lit(MAPS_URL), "place_id").alias("google_maps_url"),
        F.when(
            F.col("p.opening_hours").isNotNull(),
            _hours(
                F.coalesce("p.opening_hours.weekday_text", F.array().cast("array<string>")),
                F.col("p.opening_hours.open_now"),
            ),
        ).alias("opening_hours"),
        # the access key stays out of stored links
        F.transform(
            F.filter("p.photos", lambda x: text(x["photo_reference"]) != ""),
            lambda x: F.concat(F.lit(PHOTO_URL), x["photo_reference"]),
        ).alias("photos"),
        F.col("p.permanently_closed").alias("closed"),
    )


def openstreetmap(raw: DataFrame, run: Run) -> DataFrame:
    parsed = raw.withColumn(
        "_r", F.from_json("payload", "elements array<struct<type:string,id:string,tags:map<string,string>>>")
    )
    rows = explode_items(parsed, F.col("_r")["elements"], "el").drop("_r")
    tags = F.col("el.tags")

    def tag(name: str) -> Column:
        return F.try_element_at(tags, F.lit(name))

    street, number = text(tag("addr:street")), text(tag("addr:housenumber"))
    city = F.coalesce(tag("addr:city"), F.lit(DEFAULT_CITY))
    address = (
        F.when((street != "") & (number != ""), F.concat(street, F.lit(" "), number, F.lit(", "), city))
        .when(street != "", F.concat(street, F.lit(", "), city))
        .otherwise(city)
    )
    element = F.concat("el.type", F.lit("/"), "el.id")
    hours = text(tag("opening_hours"))
    return finish_places(
        rows.select(
            "source", *ORDER_COLUMNS,
            strip(tag("name")).alias("name"),
            address.alias("address"),
            element.alias("source_id"),
            F.coalesce(tag("addr:suburb"), tag("addr:quarter")).alias("neighborhood"),
            cuisine_from_list(tag("cuisine")).alias("cuisine"),
            F.coalesce(tag("phone"), tag("contact:phone")).alias("phone"),
            F.coalesce(tag("website"), tag("contact:website")).alias("website"),
            F.when(hours != "", _hours(raw=hours)).alias("opening_hours"),
            F.array(F.concat(F.lit("osm:"), element)).alias("tags"),
        ),
        run,
    )


def foursquare(raw: DataFrame, run: Run) -> DataFrame:
    schema = (
        "results array<struct<fsq_id:string,name:string,"
        "location:struct<address:string,locality:string,region:string,neighborhood:string>,"
        "categories:array<struct<name:string>>,price:int,rating:double,tel:string,website:string>>"
    )
    parsed = raw.withColumn("_r", F.from_json("payload", schema))
    rows = explode_items(parsed, F.col("_r")["results"], "v").drop("_r")
    where = F.col("v.location")
    parts = F.filter(F.array(where["address"], where["locality"], where["region"]), lambda p: text(p) != "")
    area = where["neighborhood"]  # text, or a list that arrives as its JSON text
    area = F.when(area.startswith("["), F.get(F.from_json(area, "array<string>"), F.lit(0))).otherwise(area)
    venue = text(F.col("v.fsq_id"))
    return finish_places(
        rows.select(
            "source", *ORDER_COLUMNS,
            strip(F.col("v.name")).alias("name"),
            or_default(F.array_join(parts, ", "), DEFAULT_CITY).alias("address"),
            venue.alias("source_id"),
            area.alias("neighborhood"),
            F.filter(F.transform("v.categories", lambda c: c["name"]), lambda n: text(n) != "").alias("cuisine"),
            F.col("v.price").alias("price_level"),
            halved_rating(F.col("v.rating")).alias("rating"),
            F.col("v.tel").alias("phone"),
            F.col("v.website").alias("website"),
            F.when(venue != "", F.concat(F.lit(VENUE_URL), venue)).alias("google_maps_url"),
        ),
        run,
    )


def _of(name: str, raw: DataFrame) -> DataFrame:
    return raw.where(F.col("source") == name)


PLACE_SOURCES: dict[str, Callable[[DataFrame, Run], DataFrame]] = {
    "google_places": lambda raw, run: google_places(
        _of("google_places", raw), _of("google_places" + DETAILS, raw), run
    ),
    "openstreetmap": lambda raw, run: openstreetmap(_of("openstreetmap", raw), run),
    "foursquare": lambda raw, run: foursquare(_of("foursquare", raw), run),
}
