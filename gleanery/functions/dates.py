"""Lenient date parsing: the common forms in the JVM, the rest through Arrow."""

from __future__ import annotations

from datetime import date, datetime, time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?(?: ?(Z|[+-]\d{2}:?\d{2}))?\z"
# Day, month by its name, year; month names also come first; a time and an offset may follow.
_MAIL = (
    r"^(?:[A-Za-z]{3}, ?)?(?:(\d{1,2}) )?([A-Z][a-z]{2,8}) (?:(\d{1,2}), )?(\d{4})"
    r"(?: (\d{2}:\d{2}(?::\d{2})?)(?: (GMT|UTC|Z|[+-]\d{4}))?)?\z"
)
# Fixed values.
_MONTHS = "January February March April May June July August September October November December".split()


def _offset(mark: Column) -> Column:
    """``Z``, ``GMT``, ``+0100`` or ``+01:00`` as an ISO offset, no mark as nothing."""
    return (
        F.when(mark == "", "")
        .when(mark.isin("Z", "GMT", "UTC"), "+00:00")
        .otherwise(F.concat(F.substring(mark, 1, 3), F.lit(":"), F.substring(mark, -2, 2)))
    )


def _lenient(default: datetime):
    @F.pandas_udf(T.StringType())
    def parse(values: pd.Series) -> pd.Series:
        from dateutil import parser

        def one(value: str) -> str | None:
            try:
                return parser.parse(value, default=default).isoformat()
            except (ValueError, TypeError, OverflowError):
                return None

        return values.map(one, na_action="ignore")

    return parse


def with_iso(df: DataFrame, column: str, to: str, run_day: date) -> DataFrame:
    """Add ISO 8601 text of a date in nearly any spelling; null when it is not a date.

    Parts a text leaves out are taken from the run day, so the result repeats.  No session
    time zone takes part.  The steps are projections of their own, because each later step
    looks at the parts several times.
    """
    raw = F.col(column)
    parts = df.withColumns(
        {
            **{f"_i{g}": F.regexp_extract(raw, _ISO, g) for g in range(1, 4)},
            **{f"_m{g}": F.regexp_extract(raw, _MAIL, g) for g in range(1, 7)},
        }
    )
    named = F.array(*[F.lit(m) for m in _MONTHS])
    found = F.array_position(F.transform(named, lambda m: (m == F.col("_m2")) | (F.left(m, F.lit(3)) == F.col("_m2"))), True)
    one_day = (F.col("_m1") == "") != (F.col("_m3") == "")
    parts = parts.withColumn("_month", F.when((F.col("_m2") != "") & one_day, found).otherwise(0))

    def clock(part: str) -> Column:
        return F.when(F.col(part) == "", "00:00").otherwise(F.col(part))

    month = F.lpad(F.col("_month").cast("string"), 2, "0")
    mail_day = F.concat("_m4", F.lit("-"), month, F.lit("-"), F.lpad(F.concat("_m1", "_m3"), 2, "0"))
    written = F.when(F.col("_i1") != "", F.concat("_i1", F.lit(" "), clock("_i2"))).when(
        F.col("_month") > 0, F.concat(mail_day, F.lit(" "), clock("_m5"))
    )
    stamped = parts.withColumns(
        {"_stamp": written.try_cast("timestamp_ntz").cast("string"), "_mark": F.concat("_i3", "_m6")}
    ).withColumn("_micros", F.regexp_extract("_stamp", r"\.(\d+)$", 1))
    common = stamped.withColumn(
        "_iso",
        F.concat(
            F.replace(F.substring("_stamp", 1, 19), F.lit(" "), F.lit("T")),
            F.when(F.col("_micros") != "", F.concat(F.lit("."), F.rpad("_micros", 6, "0"))).otherwise(""),
            _offset(F.col("_mark")),
        ),
    )
    rest = F.when(F.col("_iso").isNull() & (F.length(raw) > 0), raw)
    lenient = _lenient(datetime.combine(run_day, time()))(rest)
    done = common.withColumn("_iso", F.coalesce("_iso", lenient))
    return done.select(*[c for c in df.columns if c != to], F.col("_iso").alias(to))


def with_wall_clock(df: DataFrame, column: str, to: str, run_day: date) -> DataFrame:
    """Add the local time a date text tells, without its offset."""
    return with_iso(df, column, "_wall", run_day).withColumn(to, wall_clock(F.col("_wall"))).drop("_wall")


def wall_clock(iso: Column) -> Column:
    """The local time of an ISO text; its offset is dropped, not applied."""
    return F.regexp_replace(iso, r"(Z|[+-]\d{2}:\d{2}(:\d{2})?)\z", "").try_cast("timestamp_ntz")


def age_in_days(moment: Column, now: datetime) -> Column:
    """Whole days from ``moment`` to ``now``, rounded down (negative in the future)."""
    micros = F.timestamp_diff("MICROSECOND", moment, F.lit(now).cast("timestamp_ntz"))
    day = F.lit(86_400_000_000)
    return F.floor((micros - F.pmod(micros, day)) / day).cast("int")
