"""RSS (2 and 1.0, which is RDF) and Atom payloads to feed entries, and the feed-based sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.dates import wall_clock, with_iso
from gleanery.functions.listing import company_colon_title, title_at_company, work_mode
from gleanery.functions.text import MISSING, or_default, plain_description, strip, text
from gleanery.settings import Run
from gleanery.sources.landing import explode_items, finish_postings

# One schema for all dialects: the root element's name does not matter.  RDF has its items
# next to the channel.
FEED = (
    "channel struct<item:array<struct<title:string,link:string,description:string,pubDate:string>>>,"
    "item array<struct<title:string,link:string,description:string,`dc:date`:string>>,"
    "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,"
    "summary:string,content:string,published:string>>"
)
ENTRY = "array<struct<link:string,title:string,summary:string,published:string>>"


def _entries(feed: Column) -> Column:
    none = F.array().cast(ENTRY)
    rss = F.transform(
        feed["channel"]["item"],
        lambda i: F.struct(
            i["link"].alias("link"), i["title"].alias("title"),
            i["description"].alias("summary"), i["pubDate"].alias("published"),
        ),
    )
    rdf = F.transform(
        feed["item"],
        lambda i: F.struct(
            i["link"].alias("link"), i["title"].alias("title"),
            i["description"].alias("summary"), i["dc:date"].alias("published"),
        ),
    )
    atom = F.transform(
        feed["entry"],
        lambda e: F.struct(
            F.get(
                F.filter(e["link"], lambda k: text(k["_rel"]).isin("", "alternate")), F.lit(0)
            )["_href"].alias("link"),
            e["title"].alias("title"),
            F.coalesce(e["summary"], e["content"]).alias("summary"),
            e["published"].alias("published"),
        ),
    )
    return F.concat(*[F.coalesce(found.cast(ENTRY), none) for found in (rss, rdf, atom)])


def feed_entries(raw: DataFrame) -> DataFrame:
    """(source, source_rank, seq, pos, link, title, summary, published)"""
    parsed = raw.withColumn("_feed", F.from_xml("payload", FEED))
    rows = explode_items(parsed, _entries(F.col("_feed")), "entry").drop("_feed")
    return rows.select("*", "entry.*").drop("entry")


def bad_feeds(raw: DataFrame) -> Column:
    """Reject reason of a payload in which no feed could be read."""
    feed = F.from_xml("payload", FEED)
    return F.when(feed["channel"].isNull() & feed["item"].isNull() & feed["entry"].isNull(), "malformed feed")


@dataclass(frozen=True)
class FeedRules:
    """How one feed source fills the canonical row."""

    split: str = "at"  # "at", "colon" or "none"
    company: str = MISSING
    location: str = MISSING
    mode: str = ""  # constant mode, "" to detect
    mode_from_summary: bool = False  # remote / homeoffice in the summary, else hybrid
    clean: bool = True  # strip markup from the summary
    tags: tuple[str, ...] = ()


def feed_postings(raw: DataFrame, rules: FeedRules, run: Run) -> DataFrame:
    return finish_postings(feed_rows(feed_entries(raw), rules, run), run)


def feed_rows(
    entries: DataFrame,
    rules: FeedRules,
    run: Run,
    location: Column | None = None,
    mode: Column | None = None,
) -> DataFrame:
    raw_title = text(F.col("title"))
    if rules.split == "colon":
        title, company = company_colon_title(raw_title)
    elif rules.split == "at":
        title, company = title_at_company(strip(raw_title))
    else:
        title, company = strip(raw_title), F.lit("")
    summary = plain_description(strip(text(F.col("summary")))) if rules.clean else text(F.col("summary"))
    rows = entries.select(
        "source", "source_rank", "seq", "pos",
        F.col("link").alias("url"),
        title.alias("title"),
        (company if rules.split == "colon" else or_default(company, rules.company)).alias("company"),
        summary.alias("description"),
        F.nullif(F.col("published"), F.lit("")).alias("_published"),
        (location if location is not None else F.lit(rules.location)).alias("location"),
        (mode if mode is not None else F.lit(rules.mode)).alias("_mode"),
        F.array(*map(F.lit, rules.tags)).cast("array<string>").alias("tags"),
    )
    rows = with_iso(rows, "_published", "posted_date", run.day).drop("_published")
    rows = rows.withColumn("posted_ts", wall_clock(F.col("posted_date")))  # ISO text: not parsed again
    low = F.lower(F.col("description"))
    if rules.mode_from_summary:
        remote = F.contains(low, F.lit("remote")) | F.contains(low, F.lit("homeoffice"))
        detected = F.when(remote, "remote").otherwise("hybrid")
    else:
        detected = work_mode(F.lower(F.concat_ws(" ", "title", "description")))
    return rows.withColumn("remote_type", or_default(F.col("_mode"), detected)).drop("_mode")
