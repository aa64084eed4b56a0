"""Canonical relations and the helpers that bring a DataFrame to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
_L = T.LongType()
_I = T.IntegerType()
_STRINGS = T.ArrayType(_S)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# Where a row came from: position of the source in the enabled list, position of
# the payload in that source's output, position of the item in the payload.
ORDER_COLUMNS = ("source_rank", "seq", "pos")
ORDER = _struct(("source_rank", _I), ("seq", _L), ("pos", T.ArrayType(_I)))

POSTING = _struct(
    ("id", _S), ("title", _S), ("company", _S), ("url", _S), ("source", _S),
    ("location", _S), ("remote_type", _S), ("description", _S),
    ("posted_date", _S), ("posted_ts", T.TimestampNTZType()), ("salary", _S),
    ("tags", _STRINGS), ("first_seen", T.DateType()), ("score", _I), ("status", _S),
)

HOURS = _struct(("weekday_text", _STRINGS), ("open_now", T.BooleanType()), ("raw", _S))

PLACE = _struct(
    ("id", _S), ("name", _S), ("address", _S), ("source", _S), ("source_id", _S),
    ("neighborhood", _S), ("cuisine", _STRINGS), ("price_level", _I),
    ("rating", T.DoubleType()), ("review_count", _I), ("phone", _S), ("website", _S),
    ("google_maps_url", _S), ("opening_hours", HOURS), ("photos", _STRINGS),
    ("tags", _STRINGS), ("first_seen", T.DateType()), ("last_updated", T.DateType()),
    ("status", _S),
)

STATE = _struct(("space", _S), ("id", _S), ("status", _S), ("ts", _L))

RAW = _struct(
    ("source", _S), ("source_rank", _I), ("seq", _L),
    ("fetched_at", T.TimestampType()), ("payload", _S),
)

SOURCE_DEF = _struct(
    ("name", _S), ("type", _S), ("urls", _STRINGS), ("fields", T.MapType(_S, _S)),
    ("default_location", _S), ("default_remote", _S), ("rank", _I),
    ("bulk_only", T.BooleanType()),
)

MAIL = _struct(
    ("uid", _L), ("sender", _S), ("received", T.DateType()), ("seen", T.BooleanType()),
    ("raw", _S),
)

REJECT = _struct(("source", _S), ("seq", _L), ("reason", _S))


def conform(df: DataFrame, schema: T.StructType, *extra: str) -> DataFrame:
    """Select exactly the columns of ``schema`` (absent ones null) plus ``extra``."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ],
        *extra,
    )


def blank_to_null(column: Column, kind: T.DataType) -> Column:
    """``""``, ``0`` and an empty array all mean *unknown* in place rows."""
    if isinstance(kind, T.StringType):
        return F.nullif(column, F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(column) > 0, column)
    if isinstance(kind, T.NumericType):
        return F.nullif(column, F.lit(0).cast(kind))
    return column


def null_to_blank(column: Column, kind: T.DataType) -> Column:
    """The export form of an unknown value."""
    if isinstance(kind, T.StringType):
        return F.coalesce(column, F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(column, F.array().cast(kind))
    if isinstance(kind, T.NumericType):
        return F.coalesce(column, F.lit(0).cast(kind))
    return column


def places_with_nulls(df: DataFrame) -> DataFrame:
    return conform(df, PLACE, *_order_of(df)).withColumns(
        {f.name: blank_to_null(F.col(f.name), f.dataType) for f in PLACE.fields}
    )


def places_for_export(df: DataFrame) -> DataFrame:
    return conform(df, PLACE).withColumns(
        {f.name: null_to_blank(F.col(f.name), f.dataType) for f in PLACE.fields}
    )


def _order_of(df: DataFrame) -> list[str]:
    return [c for c in ORDER_COLUMNS if c in df.columns]


def batch_order() -> Column:
    """Position of a row in the concatenation of all sources."""
    return F.struct(*ORDER_COLUMNS)
