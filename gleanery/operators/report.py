"""The report: best new postings above a score, as rows and as one page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.display import day_text, report_entry, report_subject
from gleanery.functions.text import escape_markup, text
from gleanery.operators.retention import above, fresh
from gleanery.schema import ORDER_COLUMNS
from gleanery.settings import Preferences, Run

def top_new(new: DataFrame, prefs: Preferences, run: Run) -> DataFrame:
    """Best ``report_rows`` new rows, then threshold and freshness: the report may hold fewer.

    The order is by score, so the threshold after the limit leaves the same rows; before it
    the optimizer would copy a computed score into the filter and work it out twice.
    """
    best = new.orderBy(F.col("score").desc(), *ORDER_COLUMNS, "id").limit(prefs.report_rows)
    return fresh(above(best, prefs.report_threshold), run.day, prefs.max_age_days)


def report_rows(top: DataFrame) -> DataFrame:
    return top.select("id", "score", *ORDER_COLUMNS, report_entry().alias("html"))


def report_page(
    top: DataFrame, total: int, sources: DataFrame, board_url: str, run: Run
) -> DataFrame:
    """One row (subject, html).  Gathers the report rows only: at most ``report_rows``.

    ``total`` is the number of stored rows, ``sources(name, rank)`` the enabled sources
    that contributed, a list as short as the configuration.
    """
    rows = report_rows(top).agg(
        F.count("*").alias("n"),
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct((-F.col("score")).alias("s"), *ORDER_COLUMNS, "id", "html"))
                ),
                lambda r: r["html"],
            ),
            "\n",
        ).alias("rows"),
    )
    names = sources.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]), ", "
        )
    )
    n, day = F.col("n"), day_text(run.day)
    listed = F.when(n == 0, F.lit("<p>Nothing above the threshold came in.</p>")).otherwise(
        F.concat(F.lit("<ol>"), F.col("rows"), F.lit("</ol>"))
    )
    subject = report_subject(n, run.day)
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), subject, F.lit("</title></head><body>"),
        F.lit("<h1>"), subject, F.lit(f"</h1><p>{total} stored on {day}. <a href=\""),
        escape_markup(F.lit(board_url)), F.lit('">All postings</a></p>'), listed,
        F.lit("<p>Read from "), escape_markup(text(names.scalar())), F.lit("</p></body></html>"),
    )
    return rows.select(subject.alias("subject"), html.alias("html"))
