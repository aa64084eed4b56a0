"""What a board shows for a place, and what a report shows for a posting."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.listing import round_tenth
from gleanery.functions.text import escape_markup, or_default, strip, text

NEW_FOR_DAYS = 14
SHOWN_CUISINES = 3
REPORT_TEXT = 220


def is_new(first_seen: Column, run_day: date) -> Column:
    return F.coalesce(first_seen >= F.date_sub(F.lit(run_day), NEW_FOR_DAYS), F.lit(False))


def price_marks(level: Column) -> Column:
    return F.when(F.coalesce(level, F.lit(0)) > 0, F.repeat(F.lit("E"), level)).otherwise("")


def hours_line(hours: Column, run_day: date) -> Column:
    """Today's line of the week, else the raw opening hours, else nothing."""
    today = F.get(hours["weekday_text"], F.lit(run_day.weekday()))
    return (
        F.when(F.size(F.coalesce(hours["weekday_text"], F.array())) > 0, F.concat(F.lit("Today: "), today))
        .otherwise(text(hours["raw"]))
    )


def link_of(maps_url: Column, website: Column) -> Column:
    return or_default(maps_url, or_default(website, "#"))


def rating_text(rating: Column) -> Column:
    return F.when(F.coalesce(rating, F.lit(0.0)) != 0, F.format_string("%.1f", round_tenth(rating, ties_up=True))).otherwise("-")


def report_text(description: Column) -> Column:
    body = strip(text(description))
    short = F.when(
        F.length(body) > REPORT_TEXT, F.concat(F.substring(body, 1, REPORT_TEXT - 3), F.lit("..."))
    ).otherwise(body)
    return or_default(short, "(no description)")


def report_entry() -> Column:
    """One posting as a list item; every field is escaped, the link too."""
    facts = F.concat_ws(
        " | ",
        or_default(F.col("company"), "company unknown"),
        or_default(F.col("location"), "anywhere"),
        F.concat(F.lit("via "), text(F.col("source"))),
    )
    title = F.concat(F.lit("<a href=\""), escape_markup(text(F.col("url"))), F.lit("\">"), escape_markup(text(F.col("title"))), F.lit("</a>"))
    return F.concat(
        F.lit("<li>"), title, F.lit(" <small>score "), F.col("score").cast("string"), F.lit("</small><br>"),
        escape_markup(facts), F.lit("<p>"), escape_markup(report_text(F.col("description"))), F.lit("</p></li>"),
    )


def day_text(day: date | datetime) -> str:
    return f"{day:%A, %B} {day.day}"


def report_subject(count: Column, day: date) -> Column:
    postings = F.when(count == 1, "posting").otherwise("postings")
    number = F.when(count == 0, "No").otherwise(count.cast("string"))
    return F.concat(number, F.lit(" new "), postings, F.lit(f" on {day_text(day)}"))
