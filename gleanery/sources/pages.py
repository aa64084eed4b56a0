"""Page sources: JSON-LD presets, and the two kinds of fallback on page markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import variants as V
from gleanery.functions.text import or_default, plain_description, strip, text
from gleanery.schema import ORDER_COLUMNS
from gleanery.settings import Run
from gleanery.sources.json_ld import LdRules, ld_and_cards, ld_postings
from gleanery.sources.landing import explode_items, finish_postings
from gleanery.sources.markup import anchors, heading_cards, hydration_hits

# What the page sources fill in.
HIMALAYAS = LdRules(
    shapes=("list",), untyped_list_items=True, address=("addressCountry",),
    address_single=False, location="Remote", mode="remote", fixed_mode=True,
)
JOBGETHER = LdRules(shapes=("posting",), address=("addressCountry", "addressLocality"))
STARTUPJOBS_CZ = LdRules(shapes=("posting",), location="Czech Republic", mode="on-site")
THEORG = LdRules(shapes=("graph", "posting"))
DYNAMITE = LdRules(
    shapes=("posting", "graph"), location="Remote", fixed_location=True, mode="remote", fixed_mode=True
)
WTTJ = LdRules(shapes=("posting",))
TALENT_CZ = LdRules(shapes=("posting", "list", "graph"), location="Czech Republic")

DYNAMITE_HOST = "https://dynamitejobs.com"
WTTJ_HOST = "https://www.welcometothejungle.com"
TALENT_HOST = "https://cz.talent.com"

_HYDRATION = r"""(?is)<script\b[^>]*\bid\s*=\s*["']?__NEXT_DATA__["']?[^>]*>(.*?)</script\s*>"""


def absolute(link: Column, host: str) -> Column:
    return F.when(link.startswith("http"), link).otherwise(F.concat(F.lit(host), link))


def himalayas(pages: DataFrame, run: Run) -> DataFrame:
    return ld_postings(pages, HIMALAYAS, run)


def jobgether(pages: DataFrame, run: Run) -> DataFrame:
    return ld_postings(pages, JOBGETHER, run)


def startupjobs_cz(pages: DataFrame, run: Run) -> DataFrame:
    return ld_postings(pages, STARTUPJOBS_CZ, run)


def theorg(pages: DataFrame, run: Run) -> DataFrame:
    return ld_postings(pages, THEORG, run)


def page_anchors(pages: DataFrame) -> DataFrame:
    """(source, source_rank, seq, pos, href, title) of every link."""
    rows = explode_items(pages, anchors(F.col("payload")), "card")
    return rows.select("source", "source_rank", "seq", "pos", "card.*")


def _holding(mark: str) -> Column:
    """The payload if it holds the mark: other pages are not taken apart."""
    return F.when(F.contains("payload", F.lit(mark)), F.col("payload"))


def _filled(rows: DataFrame, card: dict[str, Column]) -> DataFrame:
    """Canonical fields of cards next to those of postings; a field that a card lacks is blank."""
    is_card = F.col("kind") == 1
    fields = ("url", "title", "company", "location", "remote_type", "description", "posted_date")
    blank = {"posted_date": F.lit(None).cast("string")}
    values = {c: F.when(is_card, card.get(c, blank.get(c, F.lit("")))).otherwise(F.col(c)) for c in fields}
    return rows.withColumns(values).drop("card")


def dynamitejobs(pages: DataFrame, run: Run) -> DataFrame:
    """Link cards count only on the first page that yields anything, and only if that
    page has no JSON-LD posting: after that there are results to keep."""
    link = F.col("card.href")
    found = ld_and_cards(pages, DYNAMITE, anchors(_holding("/remote-jobs/")))
    is_card = F.col("kind") == 1
    found = found.where(
        (is_card & F.contains(link, F.lit("/remote-jobs/")) & (F.col("card.title") != "")) | (~is_card & (text(F.col("url")) != ""))
    )
    first = found.groupBy("source").agg(
        F.min(F.when(is_card, F.col("seq"))).alias("_card_page"), F.min(F.when(~is_card, F.col("seq"))).alias("_ld_page")
    )
    used = first.select(
        "source", F.when(F.col("_ld_page").isNull() | (F.col("_card_page") < F.col("_ld_page")), F.col("_card_page")).alias("_used")
    )
    rows = _filled(
        found, {"url": absolute(link, DYNAMITE_HOST), "title": F.col("card.title"), "location": F.lit("Remote"), "remote_type": F.lit("remote")}
    )
    kept = rows.join(used, "source").where(~is_card | (F.col("seq") == F.col("_used")))
    return finish_postings(kept.drop("kind", "_used"), run)


def welcometothejungle(pages: DataFrame, run: Run) -> DataFrame:
    hits = hydration_hits(F.nullif(F.regexp_extract("payload", _HYDRATION, 1), F.lit("")))
    found = ld_and_cards(pages, WTTJ, hits).withColumn("card", V.parse(F.col("card")))
    hit = F.col("card")
    link = or_default(V.field(hit, "url"), V.field(hit, "link"))
    remote = V.field(hit, "remote")
    company = F.when(V.is_object(V.child(hit, "organization")), V.field(hit, "organization.name")).otherwise(
        V.field(hit, "company_name")
    )
    hydrated = {
        "url": absolute(F.nullif(link, F.lit("")), WTTJ_HOST),
        "title": or_default(strip(V.field(hit, "name")), strip(text(V.field(hit, "title")))),
        "company": strip(text(company)),
        "location": or_default(V.field(hit, "office_main_country"), text(V.field(hit, "location"))),
        "remote_type": F.when(remote == "fulltime", "remote").when(remote == "punctual", "hybrid").otherwise(""),
        "description": plain_description(V.field(hit, "description")),
        "posted_date": or_default(V.field(hit, "published_at"), V.field(hit, "created_at")),
    }
    return finish_postings(_filled(found, hydrated).drop("kind"), run)


def talent_cz(pages: DataFrame, run: Run) -> DataFrame:
    """A page that adds no JSON-LD posting of its own is read by its heading cards."""
    found = ld_and_cards(pages, TALENT_CZ, heading_cards(_holding("view?id=")))
    is_card = F.col("kind") == 1
    found = found.where(
        (is_card & F.contains("card.href", F.lit("view?id="))) | (~is_card & (text(F.col("url")) != ""))
    )
    # the pages whose posting is the first one with its link
    order = F.struct(*ORDER_COLUMNS)
    productive = (
        found.where(~is_card).groupBy("source", "url").agg(F.min_by("seq", order).alias("seq")).select("source", "seq").distinct()
    )
    line = F.get(F.filter("card.lines", lambda s: F.contains(s, F.lit("•"))), F.lit(0))
    dot = F.instr(line, "•")
    headed = {
        "url": absolute(F.col("card.href"), TALENT_HOST),
        "title": F.col("card.title"),
        "company": or_default(strip(F.substring(line, F.lit(1), dot - 1)), "(via Talent.com)"),
        "location": or_default(strip(F.substring(line, dot + 1, F.length(line))), "Czech Republic"),
        "remote_type": F.when(F.contains(F.lower("card.title"), F.lit("remote")), "remote").otherwise(""),
    }
    rows = _filled(found, headed)
    told = rows.join(productive.withColumn("_own", F.lit(True)), ["source", "seq"], "left")
    return finish_postings(told.where(~is_card | F.col("_own").isNull()).drop("kind", "_own"), run)
