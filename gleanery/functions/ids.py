"""Stable row ids: the first 16 hex digits of a SHA-1 over the natural key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import strip, text


def _digest(key: Column) -> Column:
    return F.substring(F.sha1(key), 1, 16)


def _pair(first: Column, second: Column) -> Column:
    return F.concat(strip(F.lower(text(first))), F.lit("|"), strip(F.lower(text(second))))


def url_key(url: Column, keep_params: Sequence[str] = ()) -> Column:
    """Lower case, without query string and trailing slashes.

    ``keep_params`` names query parameters that identify the item on sites whose item
    id lives in the query string.
    """
    low = F.lower(url)
    key = F.rtrim(F.substring_index(low, "?", 1), F.lit("/"))
    for name in keep_params:
        value = F.regexp_extract(low, f"[?&]{name.lower()}=([^&#]*)", 1)
        key = F.when(value != "", F.concat(key, F.lit(f"?{name.lower()}="), value)).otherwise(key)
    return key


def posting_id(url: Column, title: Column, company: Column, keep_params: Sequence[str] = ()) -> Column:
    return _digest(
        F.when(text(url) != "", url_key(url, keep_params)).otherwise(_pair(title, company))
    )


def place_id(source_id: Column, name: Column, address: Column) -> Column:
    return _digest(F.when(text(source_id) != "", source_id).otherwise(_pair(name, address)))
