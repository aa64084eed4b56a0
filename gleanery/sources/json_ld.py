"""JSON-LD blocks of HTML pages to postings.

All page sources share one plan; what differs per source is data (``LdRules``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import variants as V
from gleanery.functions.text import MISSING, or_default, plain_description, strip, text
from gleanery.settings import Run
from gleanery.sources.landing import explode_items, finish_postings

_BLOCK = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""


@dataclass(frozen=True)
class LdRules:
    shapes: tuple[str, ...] = ("posting", "graph", "list")  # tried in this order per entry
    untyped_list_items: bool = False  # list items need no @type
    address: tuple[str, ...] = ("addressLocality", "addressCountry")
    address_single: bool = True  # read a location object, not only a list of them
    location: str = MISSING
    fixed_location: bool = False
    company: str = ""
    mode: str = ""  # when the posting is not marked as telecommute
    fixed_mode: bool = False
    keep_params: tuple[str, ...] = ()


def _typed(items: Column) -> Column:
    return F.filter(items, lambda i: F.coalesce(V.field(i, "@type") == "JobPosting", F.lit(False)))


def _list_items(entry: Column, rules: LdRules) -> Column:
    elements = V.items(entry, "itemListElement")
    if rules.untyped_list_items:
        inner = F.transform(elements, lambda e: V.child(e, "item"))
        return F.filter(inner, lambda i: i.isNotNull() & V.is_object(i))
    inner = F.transform(
        elements,
        lambda e: F.when(V.is_object(V.child(e, "item")), V.child(e, "item")).otherwise(e),
    )
    return _typed(inner)


def _postings_in(entry: Column, rules: LdRules) -> Column:
    """The postings an entry holds, by the first shape that applies to it."""
    kind = text(V.field(entry, "@type"))
    graph = V.items(entry, "@graph")
    has_graph = V.child(entry, "@graph").isNotNull()
    chain = None
    for shape in rules.shapes:
        if shape == "posting":
            test, found = kind == "JobPosting", F.array(entry)
        elif shape == "graph":
            test, found = has_graph, _typed(graph)
        elif rules.untyped_list_items:
            test, found = F.lit(True), _list_items(entry, rules)
        else:
            test, found = kind == "ItemList", _list_items(entry, rules)
        chain = F.when(test, found) if chain is None else chain.when(test, found)
    return chain


def ld_entries(pages: DataFrame) -> DataFrame:
    """(…, pos, entry): the objects at the root of each block, lists opened."""
    blocks = explode_items(pages, F.regexp_extract_all("payload", F.lit(_BLOCK), F.lit(1)), "block")
    parsed = blocks.withColumn("block", V.parse(F.col("block")))
    roots = F.coalesce(V.items(F.col("block")), F.array("block"))
    return explode_items(parsed, roots, "entry").drop("block").where(F.col("entry").isNotNull())


def ld_items(pages: DataFrame, rules: LdRules) -> DataFrame:
    entries = ld_entries(pages)
    return explode_items(entries, _postings_in(F.col("entry"), rules), "job").drop("entry")


def ld_and_cards(pages: DataFrame, rules: LdRules, cards: Column) -> DataFrame:
    """JSON-LD postings (``kind`` 0) and what else was found on a page (``kind`` 1, ``card``),
    in one pass over the pages.  A page's postings come before its cards.

    ``cards`` is an array; the fields of a posting are null for a card.
    """
    element = pages.select(cards.alias("c")).schema["c"].dataType.elementType
    none, no_card = F.parse_json(F.lit(None).cast("string")), F.lit(None).cast(element)
    blocks = F.regexp_extract_all("payload", F.lit(_BLOCK), F.lit(1))
    found = F.concat(
        F.transform(blocks, lambda b: F.struct(F.lit(0).alias("kind"), b.alias("block"), no_card.alias("card"))),
        F.transform(
            F.coalesce(cards, F.array().cast(T.ArrayType(element))),
            lambda c: F.struct(F.lit(1).alias("kind"), F.lit(None).cast("string").alias("block"), c.alias("card")),
        ),
    )
    card = F.col("kind") == 1
    parts = explode_items(pages, found, "part").select("*", "part.*").drop("part")
    parsed = parts.withColumn("block", V.parse(F.col("block")))
    roots = F.coalesce(V.items(F.col("block")), F.array("block"))
    entries = explode_items(parsed, F.when(card, F.array(none)).otherwise(roots), "entry").drop("block")
    entries = entries.where(card | F.col("entry").isNotNull())
    jobs = F.when(card, F.array(none)).otherwise(_postings_in(F.col("entry"), rules))
    rows = ld_rows(explode_items(entries, jobs, "job").drop("entry"), rules)
    return rows.withColumn("pos", F.concat(F.array("kind"), "pos"))


def ld_rows(items: DataFrame, rules: LdRules, location: Column | None = None) -> DataFrame:
    """Canonical fields.  The payload is read in a projection of its own: what several
    rules look at is extracted once."""
    job = F.col("job")
    kept = [c for c in items.columns if c != "job"]
    default = location if location is not None else F.lit(rules.location)
    read = items.select(
        *kept,
        V.field(job, "url").alias("url"),
        V.field(job, "title").alias("title"),
        V.company_of(job).alias("company"),
        strip(V.address_part(job, rules.address, single=rules.address_single)).alias("_place"),
        V.field(job, "jobLocationType").alias("_kind"),
        V.field(job, "description").alias("description"),
        V.field(job, "datePosted").alias("posted_date"),
    )
    marked = text(F.col("_kind")) == "TELECOMMUTE"
    return read.select(
        *kept,
        "url",
        strip(text(F.col("title"))).alias("title"),
        or_default(strip(F.col("company")), rules.company).alias("company"),
        (default if rules.fixed_location else or_default(F.col("_place"), default)).alias("location"),
        (F.lit(rules.mode) if rules.fixed_mode else F.when(marked, "remote").otherwise(rules.mode)).alias("remote_type"),
        plain_description(F.col("description")).alias("description"),
        "posted_date",
    )


def ld_postings(pages: DataFrame, rules: LdRules, run: Run) -> DataFrame:
    return finish_postings(ld_rows(ld_items(pages, rules), rules), run, keep_params=rules.keep_params)


def bad_blocks(pages: DataFrame) -> DataFrame:
    """(source, seq, reason) for every block that is not JSON."""
    blocks = explode_items(pages, F.regexp_extract_all("payload", F.lit(_BLOCK), F.lit(1)), "block")
    return blocks.where(V.parse(F.col("block")).isNull()).select(
        "source", "seq", F.lit("malformed JSON-LD").alias("reason")
    )
