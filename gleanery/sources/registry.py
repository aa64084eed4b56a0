"""Source registry, source definitions and dispatch by type.

A source is a function ``(raw, run) -> postings``.  Register more with ``register``;
sources without code are entries of a definition list (``definitions``, ``read_defined``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import MISSING, or_default, text
from gleanery.schema import SOURCE_DEF
from gleanery.settings import Run
from gleanery.sources import feeds, json_api, json_ld, pages
from gleanery.sources.feeds import FeedRules, feed_entries, feed_postings, feed_rows
from gleanery.sources.mail import mail_alerts
from gleanery.sources.json_ld import LdRules, ld_items, ld_rows
from gleanery.sources.landing import POSTING_ROWS, finish_postings, posting_rejects, rejects

Source = Callable[[DataFrame, Run], DataFrame]

# What the feed sources fill in.
WEWORKREMOTELY = FeedRules(split="colon", company="", location="Remote", mode="remote", clean=False)
FREELANCERMAP = FeedRules(
    split="none", company="(freelance contract)", location="EU / Remote",
    mode_from_summary=True, clean=False, tags=("contract", "freelance"),
)
EUSTARTUPS = FeedRules(location="Europe")

SOURCES: dict[str, Source] = {
    "remotive": json_api.remotive,
    "weworkremotely": lambda raw, run: feed_postings(raw, WEWORKREMOTELY, run),
    "workingnomads": json_api.workingnomads,
    "himalayas": pages.himalayas,
    "jobgether": pages.jobgether,
    "freelancermap": lambda raw, run: feed_postings(raw, FREELANCERMAP, run),
    "dynamitejobs": pages.dynamitejobs,
    "startupjobs_cz": pages.startupjobs_cz,
    "welcometothejungle": pages.welcometothejungle,
    "theorg": pages.theorg,
    "eustartups": lambda raw, run: feed_postings(raw, EUSTARTUPS, run),
    "talent_cz": pages.talent_cz,
}


# Enabled names that stand for all user-defined sources, and for alert mails.
DEFINED, MAILED = "generic", "gmail_alerts"


@dataclass(frozen=True)
class Inputs:
    """What a run reads: landing rows, entries of user-defined sources, a mail table with the
    messages (uid) that earlier runs have taken."""

    raw: DataFrame
    definitions: Sequence[Mapping] = ()
    mail: DataFrame | None = None
    processed: DataFrame | None = None


def register(name: str, source: Source) -> None:
    SOURCES[name] = source


def read_source(name: str, raw: DataFrame, run: Run) -> DataFrame:
    """Rows of one registered source; the filter on ``source`` reaches the scan."""
    rows = SOURCES[name](raw.where(F.col("source") == name), run)
    missing = set(POSTING_ROWS.names) - set(rows.columns)
    if missing:
        raise ValueError(f"source {name!r} does not return {sorted(missing)}")
    return rows.select(*POSTING_ROWS.names)


def read_sources(names: Sequence[str], raw: DataFrame, run: Run) -> DataFrame:
    """All rows of the enabled sources; names nobody registered are left out."""
    return union_all([read_source(n, raw, run) for n in names if n in SOURCES])


def known_names(names: Sequence[str]) -> list[str]:
    """The enabled names that somebody can read, in their order."""
    return [n for n in names if n in SOURCES or n in (DEFINED, MAILED)]


def read_enabled(names: Sequence[str], inputs: Inputs, run: Run) -> DataFrame:
    """All rows of the enabled sources, with the enabled name they came by as ``reader``.

    Names nobody knows are left out; a known one without input gives no rows.
    """
    parts = []
    for rank, name in enumerate(known_names(names)):
        if name == DEFINED:
            rows = read_defined(inputs.raw, inputs.definitions, run)
        elif name == MAILED:
            if inputs.mail is None:
                continue
            rows = mail_alerts(inputs.mail, run, rank, processed=inputs.processed)
        else:
            rows = read_source(name, inputs.raw, run)
        parts.append(rows.select(*POSTING_ROWS.names, F.lit(name).alias("reader")))
    if not parts and known_names(names):
        none = inputs.raw.sparkSession.createDataFrame([], POSTING_ROWS)
        return none.withColumn("reader", F.lit(None).cast("string"))
    return union_all(parts)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no known source is enabled")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _definition_rows(entries: Sequence[Mapping]) -> list[tuple]:
    rows = []
    for rank, entry in enumerate(e for e in entries if isinstance(e, Mapping)):
        urls = entry.get("urls") or ([entry["url"]] if entry.get("url") else [])
        rows.append(
            (
                (entry.get("name") or "user_source").strip(),
                (entry.get("type") or "").lower(),
                urls,
                dict(entry.get("fields") or entry.get("mapping") or {}),
                entry.get("default_location") or "",
                entry.get("default_remote") or "",
                rank,
                bool(entry.get("bulk_only", False)),
            )
        )
    return rows


def definitions(spark: SparkSession, entries: Sequence[Mapping]) -> DataFrame:
    """Definition table from mappings; the field map may be called fields or mapping."""
    return spark.createDataFrame(_definition_rows(entries), SOURCE_DEF)


def active(defs: DataFrame, mode: str) -> DataFrame:
    """Definitions that take part in a run: some contribute to bulk runs only."""
    return defs.where((F.lit(mode) == "bulk") | ~F.coalesce("bulk_only", F.lit(False)))


def _typed(raw: DataFrame, entries: Sequence[Mapping], kind: Callable[[str], bool]) -> DataFrame:
    """Payloads of the definitions whose type is chosen, with their defaults.

    The names are a filter of their own, so that it reaches the scan; the definitions are
    configuration read by the driver, their join side a local relation of known size.
    """
    typed = [e for e in entries if kind(str(e.get("type") or "").lower())]
    defs = definitions(raw.sparkSession, typed)
    names = [row[0] for row in _definition_rows(typed)]
    chosen = raw.where(F.col("source").isin(*names)) if names else raw.where(F.lit(False))
    return chosen.join(F.broadcast(defs.select(F.col("name").alias("source"), "default_location", "default_remote")), "source")


def _defined_rows(raw: DataFrame, entries: Sequence[Mapping], run: Run) -> list[DataFrame]:
    """Unfinished rows of the user-defined sources, one part per type that is defined (one without rows if none is)."""
    place, mode = or_default(F.col("default_location"), MISSING), text(F.col("default_remote"))
    types = {str(e.get("type") or "").lower() for e in entries}
    parts = []
    if "rss" in types:
        feed = feed_rows(feed_entries(_typed(raw, entries, lambda k: k == "rss")), FeedRules(), run, place, mode)
        parts.append(feed.drop("tags"))
    if "jsonld" in types:
        rules = LdRules(company=MISSING)
        parts.append(ld_rows(ld_items(_typed(raw, entries, lambda k: k == "jsonld"), rules), rules, place))
    if "json_api" in types or not parts:
        mappings = {
            (e.get("name") or "user_source").strip(): e.get("fields") or e.get("mapping") or {}
            for e in entries
            if (e.get("type") or "").lower() == "json_api"
        }
        api = json_api.api_rows(
            json_api.api_items(_typed(raw, entries, lambda k: k == "json_api")), mappings or {"": {}},
            F.col("default_location"), mode,
        )
        parts.append(api)
    return [p.drop("default_location", "default_remote") for p in parts]


def read_defined(raw: DataFrame, entries: Sequence[Mapping], run: Run) -> DataFrame:
    """User-defined sources: one branch per type, each over its own sources' payloads.

    A source has one type, so each branch is finished on its own.
    """
    return union_all([finish_postings(p, run) for p in _defined_rows(raw, entries, run)])


def defined_rejects(raw: DataFrame, entries: Sequence[Mapping]) -> DataFrame:
    """(source, seq, reason) of payloads that could not be read, by any reader."""
    known = ("rss", "jsonld", "json_api")
    return union_all(
        [
            rejects(_typed(raw, entries, lambda k: k == "rss"), feeds.bad_feeds(raw)),
            rejects(_typed(raw, entries, lambda k: k == "json_api"), json_api.bad_arrays(raw)),
            json_ld.bad_blocks(_typed(raw, entries, lambda k: k == "jsonld")),
            rejects(_typed(raw, entries, lambda k: k not in known), F.lit("unknown source type")),
        ]
    )


def defined_row_rejects(raw: DataFrame, entries: Sequence[Mapping], run: Run) -> DataFrame:
    """(source, seq, reason) of rows that were read and are not valid."""
    return union_all([posting_rejects(p) for p in _defined_rows(raw, entries, run)])
