"""Place operators: fusion, resolution, field-level upsert, board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import match_key
from gleanery.operators.board import (
    PlaceFilter,
    cards,
    facet,
    order_places,
    place_board,
    shown_of_total,
)
from gleanery.operators.fusion import fuse, ranked, tracers
from gleanery.operators.leaders import assign_leaders, rank_keys
from gleanery.operators.state import with_status
from gleanery.operators.upsert import upsert_places
from gleanery.plans.places import resolve
from gleanery.plans.snapshot import export_places
from gleanery.schema import PLACE, conform, places_with_nulls
from gleanery.session import Scratch
from gleanery.sources.places import finish_places
from workload.tables import PLACES, RUN, RUN_DAY, plain, positions, select, table

QUERIES, ORACLE = {}, {}
PLACED = plain(PLACES)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _places(spark, sf) -> DataFrame:
    rows = select(spark, sf, PLACES).withColumns(
        {"pos": F.array(F.lit(0)), "source_id": F.concat_ws("/", "source", "seq")}
    )
    return finish_places(rows, RUN)


# Customers and suppliers as two sources that share ids: the nation key.
_RANKED = f"""
select *, row_number() over (partition by group_key order by source_rank, seq) as rn,
  nullif(neighborhood, '') as known_area, nullif(rating, 0) as known_rating, nullif(price_level, 0) as known_price
from (select source, source_rank, seq, group_key, name, rating, price_level,
  case when price_level > 2 then neighborhood else '' end as neighborhood from ({PLACED}))"""


def _sharing_ids(spark, sf) -> DataFrame:
    rows = select(spark, sf, PLACES).withColumns(
        {
            "pos": F.array(F.lit(0)),
            "id": F.col("group_key"),
            "source_id": F.col("group_key"),
            "neighborhood": F.when(F.col("price_level") > 2, F.col("neighborhood")).otherwise(""),
        }
    )
    return places_with_nulls(conform(rows, PLACE, "source_rank", "seq", "pos"))


@query(
    f"""select group_key as id, arg_min(name, rn) as name, arg_min(source, rn) as source,
    arg_min(known_area, rn) filter (where known_area is not null) as neighborhood,
    arg_min(known_rating, rn) filter (where known_rating is not null) as rating,
    cast(arg_min(known_price, rn) filter (where known_price is not null) as int) as price_level
    from ({_RANKED}) group by group_key"""
)
def exact_fusion(spark: SparkSession, sf: str) -> DataFrame:
    fused = fuse(ranked(_sharing_ids(spark, sf)), "id")
    return fused.select("id", "name", "source", "neighborhood", "rating", "price_level")


@query(f"select distinct group_key as id, source || ':' || group_key as tag from ({_RANKED}) where rn > 1")
def fusion_tracers(spark, sf):
    rows = ranked(_sharing_ids(spark, sf))
    return tracers(rows.select("id", "rank", "source", "source_id"), "id", fuse(rows, "id")).select("id", "tag")


# Copies of planted places: a place is named by two digests, a copy has two characters of the
# name changed.  Digests are no more alike than chance, copies of one place nearly equal, so
# the best-ranked copy leads.  Every third row is a copy of one and the same place.
PLANTED = f"""
select source, source_rank, seq, base, source || '/' || cast(seq as string) as id, address,
  substr(once, 1, q - 1) || 'y' || substr(once, q + 1) as name,
  case when price_level > 2 then neighborhood end as neighborhood,
  case when seq % 4 = 1 then 'p' || cast(seq as string) end as phone,
  case when seq % 5 = 2 then 'w' || cast(seq as string) end as website,
  case when seq % 7 = 3 then 'm' || cast(seq as string) end as google_maps_url,
  case when seq % 3 = 2 then 'c' || cast(seq as string) end as dish,
  case when seq % 2 = 0 and rating <> 0 then rating end as rating,
  case when seq % 6 = 5 then cast(seq as int) end as review_count,
  nullif(price_level, 0) as price_level,
  case when seq % 8 = 7 then 'h' || cast(seq as string) end as hours
from (select *, substr(digest, 1, p - 1) || 'z' || substr(digest, p + 1) as once
from (select *, md5('a' || cast(base as string)) as digest, md5('b' || cast(base as string)) as address,
  cast(seq % 32 as int) + 1 as p, cast(floor(seq / 32) as int) % 32 + 1 as q
from (select source, source_rank, seq, neighborhood, rating, price_level,
  case when seq % 3 = 0 then 0 else cast(floor(seq / 4) as int) + 1 end as base from ({PLACES}))))"""
_PLANTED = f"select *, row_number() over (partition by base order by source_rank, seq) as rn from ({plain(PLANTED)})"


def _planted(spark, sf) -> DataFrame:
    rows = select(spark, sf, PLANTED).withColumns(
        {
            "pos": F.array(F.lit(0)), "source_id": F.col("id"),
            "cuisine": F.when(F.col("dish").isNotNull(), F.array("dish")),
            "opening_hours": F.when(
                F.col("hours").isNotNull(),
                F.struct(
                    F.lit(None).cast("array<string>").alias("weekday_text"), F.lit(None).cast("boolean").alias("open_now"),
                    F.col("hours").alias("raw"),
                ),
            ),
        }
    )
    return places_with_nulls(conform(rows, PLACE, "source_rank", "seq", "pos"))


@query(
    f"""with r as ({_PLANTED}) select r.id, l.id as leader_id from r join r l on r.base = l.base and l.rn = 1"""
)
def fuzzy_planted(spark, sf):
    """Who leads each row, by similar names and addresses."""
    return resolve(_planted(spark, sf), Scratch(spark, "planted")).groups


_FIELDS = ("neighborhood", "phone", "website", "google_maps_url", "dish", "rating", "review_count", "price_level", "hours")


@query(
    "select arg_min(id, rn) as id, arg_min(name, rn) as name, arg_min(source, rn) as source, count(*) - 1 as tracers, "
    + ", ".join(f"arg_min({c}, rn) filter (where {c} is not null) as {c}" for c in _FIELDS)
    + f" from ({_PLANTED}) group by base"
)
def fusion_planted(spark, sf):
    """All nine fields that absorbed rows may fill in, and how many tracers they left."""
    found = resolve(_planted(spark, sf), Scratch(spark, "planted"))
    left = found.tracers.groupBy("id").agg(F.count("*").alias("tracers"))
    shown = found.places.withColumns({"dish": F.get("cuisine", F.lit(0)), "hours": F.col("opening_hours.raw")})
    return shown.join(left, "id", "left").select("id", "name", "source", F.coalesce("tracers", F.lit(0)).cast("long").alias("tracers"), *_FIELDS)


@query()
def fuzzy_clusters(spark, sf):
    """Customers and suppliers by name and nation: near copies throughout."""
    found = resolve(_places(spark, sf), Scratch(spark, "resolve"))
    sizes = found.groups.groupBy(F.col("leader_id").alias("id")).agg(F.count("*").alias("members"))
    return found.places.join(sizes, "id").select("id", "name", "address", "source", "members")


@query()
def fuzzy_pages(spark, sf):
    """Pages by heading and url: mostly different keys."""
    scratch = Scratch(spark, "pages")
    heading = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    keyed = table(spark, sf, "pages").select(
        match_key(F.concat_ws(" ", heading, "url")).alias("key"), F.struct("page_id").alias("rank")
    )
    keys = rank_keys(scratch.save(keyed, "keyed"), scratch)
    leads = assign_leaders(keys.select("kid", "key"), scratch)
    lead = keys.select(F.col("kid").alias("leader"), F.col("rank.page_id").alias("leader_page"))
    return keys.join(leads, "kid").join(lead, "leader").select(F.col("rank.page_id").alias("page_id"), "leader_page")


# Stored: every customer.  Incoming: those with a balance, some fields unknown, some twice.
@query(
    f"""with b as (select cast(c_custkey as varchar) as id, c_name || '!' as name,
      case when c_acctbal > 5000 then 'new ' || c_mktsegment end as neighborhood,
      case when c_acctbal > 8000 then c_acctbal end as rating, c_acctbal from customer where c_acctbal > 1000)
    select cast(c_custkey as varchar) as id, coalesce(b.name, c_name) as name,
      coalesce(b.neighborhood, c_mktsegment) as neighborhood, coalesce(b.rating, 1.5) as rating,
      cast(case when b.id is null then date '2026-06-01' else {RUN_DAY} end as varchar) as last_updated, 'visited' as status
    from customer left join b on b.id = cast(c_custkey as varchar)"""
)
def upsert_fields(spark, sf):
    base = table(spark, sf, "customer").withColumns(
        {
            "id": F.col("c_custkey").cast("string"), "name": F.col("c_name"), "neighborhood": F.col("c_mktsegment"),
            "rating": F.lit(1.5), "status": F.lit("visited"), "source": F.lit("a"),
            "first_seen": F.lit("2026-06-01"), "last_updated": F.lit("2026-06-01"),
        }
    )
    coming = base.where("c_acctbal > 1000").withColumns(
        {"source_rank": F.lit(0), "seq": F.col("c_custkey"), "pos": F.array(F.lit(0)), "status": F.lit("new")}
    )
    first = coming.withColumns(
        {
            "name": F.col("c_name"), "rating": F.when(F.col("c_acctbal") > 8000, F.col("c_acctbal")),
            "neighborhood": F.lit(""),
        }
    )
    second = coming.withColumns(
        {
            "source_rank": F.lit(1), "name": F.concat("c_name", F.lit("!")), "rating": F.lit(0.0),
            "neighborhood": F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("new "), "c_mktsegment")),
        }
    )
    order = ("source_rank", "seq", "pos")
    batch = places_with_nulls(conform(first.unionByName(second), PLACE, *order))
    out = upsert_places(places_with_nulls(conform(base, PLACE)), batch, RUN.day)
    return out.select("id", "name", "neighborhood", "rating", F.col("last_updated").cast("string").alias("last_updated"), "status")


_PARTS = """(select cast(p_partkey as varchar) as id, p_name as name, p_brand as address, p_type as neighborhood,
  p_size % 5 as price_level, p_retailprice / 400 as rating, split_part(p_name, ' ', 2) as cuisine,
  case when p_size % 4 = 0 then 'dismissed' when p_size % 4 = 1 then 'visited' else 'new' end as status, p_size
  from part)"""


def _board(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    rows = part.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("address"),
        F.col("p_type").alias("neighborhood"), (F.col("p_size") % 5).alias("price_level"),
        (F.col("p_retailprice") / 400).alias("rating"), F.col("p_size").alias("review_count"),
        F.array(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("cuisine"), F.lit("places").alias("source"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("http://x/"), "p_partkey")).alias("website"),
        F.expr("date'2026-05-01' + p_size").alias("first_seen"),
        F.struct(
            F.array(*[F.lit(d) for d in "Mon Tue Wed Thu Fri Sat Sun".split()]).alias("weekday_text"),
            F.lit(None).cast("boolean").alias("open_now"), F.lit("raw").alias("raw"),
        ).alias("opening_hours"),
    )
    states = part.where("p_size % 4 < 2").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.when(F.col("p_size") % 4 == 0, "dismissed").otherwise("visited").alias("status"),
    )
    return with_status(places_with_nulls(rows).drop("status"), states)


@query(
    f"""select id, name, status from {_PARTS} where status <> 'dismissed' and price_level = 2 and rating >= 2.27
    and contains(lower(name || ' ' || address || ' ' || neighborhood || ' ' || cuisine), 'brand#1')"""
)
def board_query(spark, sf):
    chosen = PlaceFilter(status="hide_dismissed", price=2, min_rating=2.27, search=" Brand#1")
    return place_board(_board(spark, sf), chosen).select("id", "name", "status")


@query(f"select id, name from {_PARTS} where status = 'visited' and cuisine = 'ring' and neighborhood = 'SMALL'")
def board_facets_chosen(spark, sf):
    chosen = PlaceFilter(status="visited", source="places", cuisine="ring", neighborhood="SMALL")
    return place_board(_board(spark, sf), chosen, "name").select("id", "name")


_SORTS = {"rating": "rating desc", "name": "name", "newest": "p_size desc", "reviews": "p_size desc"}


@query(
    " union all ".join(
        f"select '{sort}' as sort, id, name, row_number() over (partition by price_level order by {keys}, id) as place from {_PARTS}"
        for sort, keys in _SORTS.items()
    )
)
def board_orders(spark, sf):
    """Every order over the whole board; a row's place in it is told inside its price level."""
    board = _board(spark, sf)
    parts = [
        positions(order_places(board, sort), "price_level", "place").select(F.lit(sort).alias("sort"), "id", "name", "place")
        for sort in _SORTS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"select count(*) filter (where status = 'visited' and price_level = 1) as shown, count(*) as total from {_PARTS}")
def board_counts(spark, sf):
    return shown_of_total(_board(spark, sf), PlaceFilter(status="visited", price=1))


@query(f"select cuisine as value, count(*) as n from {_PARTS} group by 1")
def facet_cuisine(spark, sf):
    return facet(_board(spark, sf), "cuisine")


@query(f"select neighborhood as value, count(*) as n from {_PARTS} group by 1")
def facet_neighborhood(spark, sf):
    return facet(_board(spark, sf), "neighborhood")


@query(f"""select id, name, rating, case when p_size % 2 = 0 then 'http://x/' || id else '' end as website, '' as phone,
    0 as photos, cast(date '2026-05-01' + p_size as varchar) as first_seen from {_PARTS}""")
def places_export_rows(spark, sf):
    """The stored document as JSON lines: blanks for what is unknown."""
    path = Scratch(spark, "export").path("places")
    export_places(_board(spark, sf), path)
    read = spark.read.schema(PLACE).json(path)
    return read.select("id", "name", "rating", "website", "phone", F.size("photos").alias("photos"), F.col("first_seen").cast("string").alias("first_seen"))


@query(
    f"""select id, case when p_size % 2 = 0 then 'http://x/' || id else '#' end as link,
    date '2026-05-01' + p_size >= {RUN_DAY} - 14 as is_new, repeat('E', cast(price_level as int)) as price,
    format('{{:.1f}}', case when rating * 4 = floor(rating * 4) then rating + 0.001 else rating end) as rating, 'Today: Wed' as hours, cuisine from {_PARTS}"""
)
def place_cards(spark, sf):
    shown = cards(_board(spark, sf), RUN.day)
    return shown.select("id", "link", "is_new", "price", "rating", "hours", F.array_join("cuisine", ",").alias("cuisine"))
