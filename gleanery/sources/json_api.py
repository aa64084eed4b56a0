"""JSON payloads that hold an array of postings, with a field mapping per source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import variants as V
from gleanery.functions.text import (
    MISSING,
    decoded_description,
    or_default,
    plain_description,
    strip,
    text,
)
from gleanery.settings import Run
from gleanery.sources.landing import explode_items, finish_postings

# Keys under which the array may sit, in this order.
ARRAY_KEYS = ("jobs", "data", "results", "items", "postings", "openings")
MAPPED = ("url", "title", "company", "location", "description", "posted_date")


def api_items(raw: DataFrame, keys: Sequence[str] = ARRAY_KEYS, at_root: bool = True) -> DataFrame:
    """(…, pos, item): the objects of the first array found."""
    parsed = raw.withColumn("_json", V.parse(F.col("payload")))
    places = [V.items(F.col("_json"))] if at_root else []
    places += [V.items(F.col("_json"), key) for key in keys]
    rows = explode_items(parsed, F.coalesce(*places), "item").drop("_json")
    return rows.where(V.is_object(F.col("item")))


def bad_arrays(raw: DataFrame) -> Column:
    """Reject reason of a payload that is not JSON or has no array."""
    value = V.parse(F.col("payload"))
    found = F.coalesce(V.items(value), *[V.items(value, key) for key in ARRAY_KEYS])
    return F.when(value.isNull(), "malformed JSON").when(found.isNull(), "no array of postings")


def mapped_field(name: str, mappings: Mapping[str, Mapping[str, str]]) -> Column:
    """The value of one canonical field for every source.

    Sources with the same path share a branch, so the expression grows with the number
    of different paths, not with the number of sources.
    """
    by_path: dict[str, list[str]] = {}
    for source, fields in mappings.items():
        by_path.setdefault(fields.get(name, name), []).append(source)
    item = F.col("item")
    if len(by_path) == 1:
        return V.field(item, next(iter(by_path)))
    chain = None
    for path, sources in by_path.items():
        test, value = F.col("source").isin(*sources), V.field(item, path)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def api_rows(
    items: DataFrame,
    mappings: Mapping[str, Mapping[str, str]],
    location: Column | None = None,
    mode: Column | None = None,
) -> DataFrame:
    value = {name: mapped_field(name, mappings) for name in MAPPED}
    default = location if location is not None else F.lit("")
    return items.select(
        "source", "source_rank", "seq", "pos",
        value["url"].alias("url"),
        strip(text(value["title"])).alias("title"),
        or_default(strip(text(value["company"])), MISSING).alias("company"),
        or_default(strip(or_default(value["location"], default)), MISSING).alias("location"),
        (mode if mode is not None else F.lit("")).alias("remote_type"),
        plain_description(value["description"]).alias("description"),
        value["posted_date"].alias("posted_date"),
    )


def remotive(raw: DataFrame, run: Run) -> DataFrame:
    """``{jobs: […]}``; entities decoded, salary and tags kept."""
    item = F.col("item")
    rows = api_items(raw, ("jobs",), at_root=False).select(
        "source", "source_rank", "seq", "pos",
        V.field(item, "url").alias("url"),
        strip(text(V.field(item, "title"))).alias("title"),
        strip(text(V.field(item, "company_name"))).alias("company"),
        or_default(strip(V.field(item, "candidate_required_location")), "Remote").alias("location"),
        F.lit("remote").alias("remote_type"),
        decoded_description(V.field(item, "description")).alias("description"),
        V.field(item, "publication_date").alias("posted_date"),
        strip(text(V.field(item, "salary"))).alias("salary"),
        F.try_variant_get(item, '$["tags"]', "array<string>").alias("tags"),
    )
    return finish_postings(rows, run)


def workingnomads(raw: DataFrame, run: Run) -> DataFrame:
    """Root array; tags as an array or a comma list; equal urls are kept."""
    item = F.col("item")
    tags = F.try_variant_get(item, '$["tags"]', "array<string>")
    words = F.filter(
        F.transform(F.split(text(V.field(item, "tags")), ","), strip), lambda w: w != ""
    )
    rows = api_items(raw, ()).select(
        "source", "source_rank", "seq", "pos",
        V.field(item, "url").alias("url"),
        strip(text(V.field(item, "title"))).alias("title"),
        strip(text(V.field(item, "company_name"))).alias("company"),
        or_default(strip(V.field(item, "location")), "Remote").alias("location"),
        F.lit("remote").alias("remote_type"),
        text(V.field(item, "description")).alias("description"),
        V.field(item, "pub_date").alias("posted_date"),
        F.coalesce(tags, words).alias("tags"),
    )
    return finish_postings(rows, run, distinct_urls=False)
