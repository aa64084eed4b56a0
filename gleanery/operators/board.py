"""Board queries on a snapshot: filters, orders, facets, lookups."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.display import (
    SHOWN_CUISINES,
    hours_line,
    is_new,
    link_of,
    price_marks,
    rating_text,
)
from gleanery.functions.matching import haystack, joined
from gleanery.functions.text import text


@dataclass(frozen=True)
class PlaceFilter:
    """Empty values do not filter.  ``status`` may be a status or ``hide_dismissed``."""

    status: str = ""
    source: str = ""
    price: int = 0
    min_rating: float = 0.0
    cuisine: str = ""
    neighborhood: str = ""
    search: str = ""

    def conditions(self) -> list[Column]:
        found = []
        if self.status == "hide_dismissed":
            found.append(F.col("status") != "dismissed")
        elif self.status:
            found.append(F.col("status") == self.status)
        if self.source:
            found.append(F.col("source") == self.source)
        if self.price:
            found.append(F.col("price_level") == self.price)
        if self.min_rating:
            found.append(F.col("rating") >= self.min_rating)
        if self.cuisine:
            found.append(F.array_contains("cuisine", self.cuisine))
        if self.neighborhood:
            found.append(F.col("neighborhood") == self.neighborhood)
        needle = self.search.lower().strip()
        if needle:
            hay = haystack(
                F.col("name"), F.col("address"), F.col("neighborhood"),
                joined(F.col("cuisine")), joined(F.col("tags")),
            )
            found.append(F.contains(hay, F.lit(needle)))
        return found


@dataclass(frozen=True)
class PostingFilter:
    min_score: int | None = None
    source: str = ""
    location: str = ""
    remote_type: str = ""
    within_days: int | None = None
    status: str = ""

    def conditions(self, run_day: date) -> list[Column]:
        found = []
        if self.min_score is not None:
            found.append(F.col("score") >= self.min_score)
        if self.source:
            found.append(F.col("source") == self.source)
        if self.location:
            found.append(F.contains(F.lower(text(F.col("location"))), F.lit(self.location.lower())))
        if self.remote_type:
            found.append(F.col("remote_type") == self.remote_type)
        if self.within_days is not None:
            anchor = F.coalesce(F.col("posted_ts").cast("date"), F.col("first_seen"))
            found.append(anchor >= F.date_sub(F.lit(run_day), self.within_days))
        if self.status:
            found.append(F.col("status") == self.status)
        return found


def _where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for condition in conditions:
        df = df.where(condition)
    return df


def place_board(places: DataFrame, chosen: PlaceFilter, sort: str = "rating") -> DataFrame:
    return order_places(_where_all(places, chosen.conditions()), sort)


def posting_board(postings: DataFrame, chosen: PostingFilter, run_day: date) -> DataFrame:
    return snapshot_order(_where_all(postings, chosen.conditions(run_day)), "score")


def order_places(places: DataFrame, sort: str) -> DataFrame:
    keys = {
        "rating": F.coalesce("rating", F.lit(0.0)).desc(),
        "newest": F.col("first_seen").desc_nulls_last(),
        "name": F.collate(text(F.col("name")), "UNICODE").asc(),
        "reviews": F.coalesce("review_count", F.lit(0)).desc(),
    }
    return places.orderBy(keys[sort], "id") if sort in keys else places


def snapshot_order(df: DataFrame, measure: str) -> DataFrame:
    """Newest first, then the measure, then id so that equal rows keep one order."""
    return df.orderBy(F.col("first_seen").desc(), F.col(measure).desc(), "id")


def facet(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values with their row counts, in value order."""
    kind = df.schema[column].dataType.typeName()
    values = df.select((F.explode(column) if kind == "array" else F.col(column)).alias("value"))
    return values.where(text(F.col("value")) != "").groupBy("value").agg(F.count("*").alias("n")).orderBy("value")


def by_id(df: DataFrame, row_id: str) -> DataFrame:
    return df.where(F.col("id") == row_id)


def ids(df: DataFrame) -> DataFrame:
    return df.select("id")


def cards(places: DataFrame, run_day: date) -> DataFrame:
    """What the board prints per place."""
    return places.select(
        "id", "name",
        link_of(F.col("google_maps_url"), F.col("website")).alias("link"),
        is_new(F.col("first_seen"), run_day).alias("is_new"),
        price_marks(F.col("price_level")).alias("price"),
        rating_text(F.col("rating")).alias("rating"),
        hours_line(F.col("opening_hours"), run_day).alias("hours"),
        F.slice(F.coalesce("cuisine", F.array().cast("array<string>")), 1, SHOWN_CUISINES).alias("cuisine"),
    )


def shown_of_total(places: DataFrame, chosen: PlaceFilter) -> DataFrame:
    """One row (shown, total) in a single scan."""
    keep = F.lit(True)
    for condition in chosen.conditions():
        keep = keep & F.coalesce(condition, F.lit(False))
    return places.agg(F.count(F.when(keep, 1)).alias("shown"), F.count("*").alias("total"))
