"""Which rows stay, which are fresh, which are new."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleanery.functions.dates import with_wall_clock
from gleanery.functions.text import text

RETENTION_DAYS = 60
# Statuses that protect a row from removal.
PROTECTED = ("interested", "applied")


def is_retained(run_day: date, days: int = RETENTION_DAYS) -> Column:
    recent = F.col("first_seen") >= F.date_sub(F.lit(run_day), days)
    return recent | F.col("status").isin(*PROTECTED)


def retain(df: DataFrame, run_day: date, days: int = RETENTION_DAYS) -> DataFrame:
    return df.where(is_retained(run_day, days))


def _totals(run_day: date, days: int) -> list[Column]:
    gone = ~F.coalesce(is_retained(run_day, days), F.lit(False))
    return [F.count("*").alias("before"), F.count(F.when(gone, 1)).alias("removed")]


def retention_totals(df: DataFrame, run_day: date, days: int = RETENTION_DAYS) -> dict[str, int]:
    """How many rows there are and how many of them go, by a scan of their own."""
    return df.agg(*_totals(run_day, days)).first().asDict()


def retain_counted(
    df: DataFrame, run_day: date, days: int = RETENTION_DAYS
) -> tuple[DataFrame, Observation]:
    """Retained rows, and an observation ``removed`` filled when they are written."""
    seen = Observation("retention")
    return df.observe(seen, *_totals(run_day, days)).where(is_retained(run_day, days)), seen


def is_fresh(run_day: date, max_age_days: int) -> Column:
    """Posted date, else first seen, not older than the limit.

    A posted date nobody can read does not fall back to first seen: the row stays.
    """
    dated = text(F.col("posted_date")) != ""
    anchor = F.when(dated, F.col("posted_ts").cast("date")).otherwise(F.col("first_seen"))
    return anchor.isNull() | (F.datediff(F.lit(run_day), anchor) <= max_age_days)


def fresh(df: DataFrame, run_day: date, max_age_days: int = 14) -> DataFrame:
    if "posted_ts" in df.columns:
        return df.where(is_fresh(run_day, max_age_days))
    dated = with_wall_clock(df, "posted_date", "posted_ts", run_day)
    return dated.where(is_fresh(run_day, max_age_days)).drop("posted_ts")


def above(df: DataFrame, threshold: int) -> DataFrame:
    return df.where(F.col("score") >= threshold)


def new_since(df: DataFrame, run_day: date, days: int = 7) -> DataFrame:
    return df.where(F.col("first_seen") >= F.date_sub(F.lit(run_day), days))
