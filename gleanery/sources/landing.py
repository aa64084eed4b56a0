"""The landing contract: one row per fetched payload, in a known order.

``raw(source, source_rank, seq, fetched_at, payload)``.  Store it partitioned by source
and day so a run reads only what it needs; readers filter on ``source`` first, and that
filter reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.dates import with_wall_clock
from gleanery.functions.ids import posting_id
from gleanery.functions.text import text
from gleanery.operators.order import first_wins
from gleanery.schema import ORDER, ORDER_COLUMNS, POSTING, RAW, conform
from gleanery.settings import Run

POSTING_ROWS = T.StructType(POSTING.fields + ORDER.fields)


def landing(df: DataFrame) -> DataFrame:
    return conform(df, RAW)


def explode_items(raw: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """One row per element; its position in the payload extends the row's order.

    The outer form, because before a plain explode Spark filters on the size of the array
    and would parse every payload once more for that.
    """
    kept = [c for c in raw.columns if c not in ("payload", "fetched_at", "pos", "_items")]
    start = F.col("pos") if "pos" in raw.columns else F.array().cast("array<int>")
    return (
        raw.withColumns({"_items": items, "_start": start})
        .select(*kept, "_start", F.posexplode_outer("_items").alias("_at", name))
        .where(F.col("_at").isNotNull())
        .select(*kept, F.concat("_start", F.array("_at")).alias("pos"), name)
    )


def finish_postings(
    rows: DataFrame, run: Run, distinct_urls: bool = True, keep_params: Sequence[str] = ()
) -> DataFrame:
    """Validity, first-wins by url inside the source, id, dates and defaults."""
    valid = rows.where(text(F.col("url")) != "")
    if distinct_urls:
        valid = first_wins(valid, ["source", "url"], ORDER_COLUMNS)
    have = set(valid.columns)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    empty = F.lit("")
    posted = F.nullif(F.col("posted_date"), empty) if "posted_date" in have else F.lit(None).cast("string")
    filled = valid.withColumns(
        {
            **{c: given(c, empty) for c in ("title", "company", "location", "remote_type", "description", "salary")},
            "tags": given("tags", F.array().cast("array<string>")),
            "posted_date": posted,
            "status": given("status", F.lit("new")),
            "first_seen": F.lit(run.day),
            "score": F.lit(0),
        }
    )
    keyed = filled.withColumn("id", posting_id(F.col("url"), F.col("title"), F.col("company"), keep_params))
    if "posted_ts" not in have:
        keyed = with_wall_clock(keyed, "posted_date", "posted_ts", run.day)
    return conform(keyed, POSTING_ROWS)


def posting_rejects(rows: DataFrame) -> DataFrame:
    """(source, seq, reason) of unfinished rows that ``finish_postings`` leaves out as not valid."""
    return rejects(rows, F.when(text(F.col("url")) == "", "no url"))


def rejects(rows: DataFrame, reason: Column) -> DataFrame:
    """Rows for which ``reason`` is not null, as (source, seq, reason)."""
    return rows.select("source", "seq", reason.alias("reason")).where(F.col("reason").isNotNull())


def reject_counts(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("source", "reason").agg(F.count("*").alias("n"))
