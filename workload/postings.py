"""Posting operators: ids, score, upsert, retention, report, board, bookkeeping."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.dates import age_in_days, wall_clock, with_iso
from gleanery.functions.ids import place_id, posting_id
from gleanery.functions.listing import (
    company_colon_title,
    title_at_company,
    work_mode,
    work_mode_with_site,
)
from gleanery.functions.matching import contains_word
from gleanery.functions.scoring import score
from gleanery.functions.text import collapse_blanks, escape_markup, match_key, or_default, strip_tags
from gleanery.functions.display import report_text
from gleanery.operators import health
from gleanery.operators.board import (
    PostingFilter,
    by_id,
    posting_board,
    snapshot_order,
)
from gleanery.operators.order import first_wins, last_wins
from gleanery.operators.report import report_page, top_new
from gleanery.operators.retention import fresh, is_retained, new_since, retain
from gleanery.operators.upsert import new_rows, upsert_postings
from gleanery.plans.snapshot import SnapshotTable, export_postings
from gleanery.schema import POSTING, conform
from gleanery.session import Scratch
from workload.tables import (
    POSTINGS,
    PREFS,
    RUN,
    RUN_DAY,
    first_sql,
    id_sql,
    positions,
    plain,
    postings,
    select,
    strip_sql,
    table,
    tags_out_sql,
    word_sql,
)

QUERIES, ORACLE = {}, {}
POSTED = plain(POSTINGS)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query(f"select page_id, {id_sql()} as id from pages")
def canonical_id(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf, "pages").select("page_id", posting_id(F.col("url"), none, none).alias("id"))


@query(
    "select s_suppkey, substr(sha1(case when s_suppkey % 2 = 0 then s_name else lower(s_name) || '|' || "
    "cast(s_nationkey as varchar) end), 1, 16) as id from supplier"
)
def place_ids(spark, sf):
    given = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("")
    key = place_id(given, F.concat(F.lit("  "), "s_name"), F.concat(F.col("s_nationkey").cast("string"), F.lit(" ")))
    return table(spark, sf, "supplier").select("s_suppkey", key.alias("id"))


@query(
    f"select doc_id, {word_sql('lower(text)', ['of the'])} as of_the, "
    f"{word_sql('lower(text)', ['le', 'und'])} as le_und from documents"
)
def whole_word_match(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        contains_word(low, ["of the"]).alias("of_the"),
        contains_word(low, ["le", "UND"]).alias("le_und"),
    )


_AGE = f"date_diff('day', cast(nullif(posted_date, '') as date), {RUN_DAY})"
_HAY = (
    "lower(title || ' ' || company || ' ' || description || ' ' || location || ' ' || lang || ' ' || source)"
)
_CONTRACT = "'fractional|interim|contract|freelance|part-time|part time'"
SCORE_SQL = f"""
  case when {word_sql('lower(title)', PREFS.strong)} then 30 when {word_sql('hay', PREFS.strong)} then 15 else 0 end
+ case when {word_sql('lower(title)', PREFS.good)} then 12 when {word_sql('hay', PREFS.good)} then 5 else 0 end
- case when {word_sql('lower(title)', PREFS.avoid)} then 40 else 0 end
+ case when {word_sql('hay', PREFS.priority_places)} then 20 when {word_sql('hay', PREFS.acceptable_places)} then 8 else 0 end
+ case when lower(remote_type) in ('remote', 'hybrid') then 10 when contains(hay, 'remote') then 5 else 0 end
+ case when age <= 2 then 8 when age <= 7 then 4 when age > 30 then -5 else 0 end
+ case when regexp_matches(hay, {_CONTRACT}) then 6 else 0 end
- case when {word_sql('lower(title)', ['und'])} then 12 else 0 end
- case when {word_sql('lower(title)', ['de'])} then 12 else 0 end
- case when contains(lower(company), 'company src1') then 25 else 0 end"""
SCORED = f"""select *, cast({SCORE_SQL} as int) as score from
(select *, {_HAY} as hay, {_AGE} as age from ({POSTED}))"""


@query(f"select doc_id, score from ({SCORED})")
def relevance_score(spark, sf):
    return score(postings(spark, sf).drop("score"), PREFS, RUN).select("doc_id", "score")


_KNOWN = "first_seen < date '2026-06-01'"
_TOP = f"""
select * from (select doc_id, score, title, posted_date, source_rank,
    coalesce(cast(nullif(posted_date, '') as date), first_seen) as anchor,
    row_number() over (order by score desc, source_rank, doc_id) as rn
  from ({SCORED}) where not ({_KNOWN}) and score >= {PREFS.report_threshold})
where rn <= {PREFS.report_rows} and date_diff('day', anchor, {RUN_DAY}) <= 14"""


def _new_scored(spark, sf):
    rows = postings(spark, sf).withColumn("id", F.col("doc_id").cast("string"))
    fresh_rows = new_rows(rows, rows.where(F.expr(_KNOWN)))
    return score(fresh_rows.drop("score"), PREFS, RUN)


@query(f"select doc_id, score, title from ({_TOP})")
def top_k_new(spark, sf):
    rows = _new_scored(spark, sf).withColumn("id", F.col("doc_id").cast("string"))
    return top_new(rows, PREFS, RUN).select("doc_id", "score", "title")


def _escaped(expression: str) -> str:
    return (
        f"replace(replace(replace(replace({expression}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    )


_BODY = strip_sql("description")


@query(
    f"""select doc_id, {_escaped(f"case when length({_BODY}) > 220 then substr({_BODY}, 1, 217) || '...' "
    f"when {_BODY} = '' then '(no description)' else {_BODY} end")} as body,
    {_escaped('title')} as heading, case remote_type when '' then '—' else remote_type end as mode
    from ({POSTED})"""
)
def report_rows(spark, sf):
    return postings(spark, sf).select(
        "doc_id",
        escape_markup(report_text(F.col("description"))).alias("body"),
        escape_markup(F.col("title")).alias("heading"),
        or_default(F.col("remote_type"), "—").alias("mode"),
    )


@query(
    f"""select case count(*) when 0 then 'No' else cast(count(*) as varchar) end || case count(*) when 1 then ' new posting' else ' new postings' end
    || ' on Wednesday, July 1' as subject, (select count(*) from documents) as stored, count(*) as listed from ({_TOP})"""
)
def report_page_subject(spark, sf):
    rows = _new_scored(spark, sf).withColumn("id", F.col("doc_id").cast("string"))
    sources = table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(
        F.min(F.substring("source", 4, 9).cast("int")).alias("rank")
    )
    total = table(spark, sf, "documents").count()
    page = report_page(top_new(rows, PREFS, RUN), total, sources, "https://board.example.com/", RUN)
    shown = F.regexp_extract("html", r"<p>(\d+) stored", 1).cast("bigint")
    listed = F.size(F.split("html", "<li><a href=")) - 1
    return page.select("subject", shown.alias("stored"), listed.cast("bigint").alias("listed"))


# Stored: orders before 1999.  Incoming: later orders, and changed copies of part of the
# stored ones, some ids more than once.
ORDERS = """
select cast(o_orderkey as string) as id, 0 as source_rank, o_orderkey as seq, o_orderkey,
  o_orderpriority as title, o_orderstatus as company, o_totalprice, o_custkey,
  cast(o_orderdate as date) as first_seen,
  case o_orderstatus when 'F' then 'applied' when 'P' then 'seen' else 'new' end as status
from {orders}"""
INCOMING = """
select id, 1 as source_rank, seq, o_orderkey, title, 'first' as company, date '2026-07-01' as first_seen, 'new' as status
from ({o}) where first_seen >= date '1999-01-01' or o_totalprice > 250000
union all
select id, 2 as source_rank, seq, o_orderkey, 'again ' || title as title, 'second' as company, date '2026-07-02' as first_seen,
  case when o_custkey % 2 = 0 then 'interested' else 'new' end as status
from ({o}) where o_totalprice > 300000"""


def _orders(spark, sf):
    stored = select(spark, sf, ORDERS).where("first_seen < date '1999-01-01'")
    incoming = select(spark, sf, INCOMING.replace("{o}", ORDERS))
    return conform(stored, POSTING), conform(
        incoming.withColumn("pos", F.array(F.lit(0))), POSTING, "source_rank", "seq", "pos"
    )


_ORDERS_SQL = plain(ORDERS)
_UPSERTED = f"""
with o as ({_ORDERS_SQL}), s as (select * from o where first_seen < date '1999-01-01'),
i as ({plain(INCOMING.replace('{o}', 'select * from o'))}),
b as (select id, arg_max(title, source_rank) as title, arg_max(company, source_rank) as company,
  arg_min(first_seen, source_rank) as first_seen,
  coalesce(arg_min(status, source_rank) filter (where status <> 'new'), 'new') as status from i group by id)
select coalesce(s.id, b.id) as id, coalesce(b.title, s.title) as title, coalesce(b.company, s.company) as company,
  cast(coalesce(s.first_seen, b.first_seen) as varchar) as first_seen,
  coalesce(nullif(s.status, 'new'), b.status, 'new') as status, s.id is null as is_new
from s full outer join b on s.id = b.id"""


def _upsert_columns(df):
    return df.select("id", "title", "company", F.col("first_seen").cast("string").alias("first_seen"), "status", "is_new")


@query(_UPSERTED)
def upsert_orders(spark, sf):
    return _upsert_columns(upsert_postings(*_orders(spark, sf)))


@query(_UPSERTED)
def upsert_bucketed_snapshot(spark, sf):
    """The same upsert against a stored version that is bucketed by id."""
    stored, incoming = _orders(spark, sf)
    snapshots = SnapshotTable(spark, Scratch(spark, "upsert").path("snapshot"), POSTING, buckets=8)
    snapshots.write(stored)
    return _upsert_columns(upsert_postings(snapshots.read(), incoming, snapshots.buckets))


@query(_UPSERTED)
def upsert_two_versions(spark, sf):
    """The first half of the batch makes a second version in another layout, the rest meets that one."""
    stored, incoming = _orders(spark, sf)
    root = Scratch(spark, "versions").path("snapshot")
    wide, narrow = (SnapshotTable(spark, root, POSTING, buckets=n) for n in (8, 3))
    wide.write(stored)
    even = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    first = upsert_postings(wide.read(), incoming.where(even), wide.buckets_of(1))
    fresh = Scratch(spark, "versions").save(first.where("is_new").select("id"), "fresh")
    narrow.write(first, clustered=wide.buckets_of(1))
    second = upsert_postings(narrow.read(), incoming.where(~even), narrow.buckets_of(2))
    came = second.join(fresh.withColumn("_first", F.lit(True)), "id", "left")
    return _upsert_columns(came.withColumn("is_new", F.col("is_new") | F.col("_first").isNotNull()))


@query(f"select id, title from ({_UPSERTED}) where is_new")
def upsert_new_rows(spark, sf):
    stored, incoming = _orders(spark, sf)
    latest = last_wins(incoming, ["id"], ["source_rank", "seq", "pos"])
    return new_rows(latest, stored).select("id", "title")


@query(f"select id, title, status, cast(first_seen as varchar) as first_seen from ({_ORDERS_SQL})")
def snapshot_roundtrip(spark, sf):
    """Write a version, read it back."""
    rows = conform(select(spark, sf, ORDERS), POSTING)
    snapshots = SnapshotTable(spark, Scratch(spark, "roundtrip").path("snapshot"), POSTING, buckets=8)
    snapshots.write(rows)
    return snapshots.read().select("id", "title", "status", F.col("first_seen").cast("string").alias("first_seen"))




@query(
    f"""select doc_id, status from ({POSTED})
    where first_seen >= {RUN_DAY} - 60 or status in ('interested', 'applied')"""
)
def retention(spark, sf):
    return retain(postings(spark, sf), RUN.day).select("doc_id", "status")


@query(
    f"""select count(*) as before, count(*) filter (where not
    (first_seen >= {RUN_DAY} - 60 or status in ('interested', 'applied'))) as removed from ({POSTED})"""
)
def retention_counts(spark, sf):
    kept = is_retained(RUN.day)
    return postings(spark, sf).agg(
        F.count("*").alias("before"), F.count(F.when(~kept, 1)).alias("removed")
    )


@query(
    f"""select doc_id from ({POSTED}) where
    date_diff('day', coalesce(cast(nullif(posted_date, '') as date), first_seen), {RUN_DAY}) <= 14"""
)
def freshness(spark, sf):
    return fresh(postings(spark, sf), RUN.day, 14).select("doc_id")


@query("select event_id from events where cast(ts as date) >= date '2024-01-31' - 7")
def new_since_days(spark, sf):
    rows = table(spark, sf, "events").withColumn("first_seen", F.col("ts").cast("date"))
    return new_since(rows, date(2024, 1, 31), 7).select("event_id")


@query(
    "select user_id, event_type, event_id from ("
    + first_sql("select * from events", "user_id, event_type", "ts, event_id")
    + ")"
)
def first_wins_per_key(spark, sf):
    return first_wins(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id"
    )


@query(
    "select user_id, event_id, value from ("
    + first_sql("select * from events", "user_id", "ts desc, event_id desc")
    + ")"
)
def last_wins_per_key(spark, sf):
    return last_wins(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "value"
    )


# The enabled list: more names than there are sources.
ENABLED = [f"src{i}" for i in range(25)]
_ENABLED_SQL = "(select 'src' || i as name, cast(i as int) as rank from range(25) t(i))"


def _counts(spark, sf):
    return health.ranked_names(spark, ENABLED), health.rows_per_source(table(spark, sf, "documents"))


@query(
    f"""select e.name, e.rank, coalesce(c.n, 0) as n from {_ENABLED_SQL} e
    left join (select source, count(*) as n from documents group by source) c on e.name = c.source"""
)
def source_health(spark, sf):
    return health.source_counts(*_counts(spark, sf))


@query(f"select name, rank from {_ENABLED_SQL} where name not in (select source from documents)")
def silent_sources(spark, sf):
    return health.silent_sources(*_counts(spark, sf)).select("name", "rank")


@query(f"select name, rank from {_ENABLED_SQL} where name in (select source from documents)")
def contributing_sources(spark, sf):
    return health.contributing_sources(*_counts(spark, sf))


@query(f"select name, rank from {_ENABLED_SQL} where name not in (select source from documents)")
def unknown_sources(spark, sf):
    registry = table(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    return health.unknown_sources(health.ranked_names(spark, ENABLED), registry)


@query(f"select name, rank from {_ENABLED_SQL} where name in (select source from documents)")
def known_sources(spark, sf):
    registry = table(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    return health.known_sources(health.ranked_names(spark, ENABLED), registry)


@query(f"select page_id, trim(regexp_replace({tags_out_sql('html')}, '\\s+', ' ', 'g')) as body from pages")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", collapse_blanks(strip_tags(F.col("html"))).alias("body"))


@query(
    "select doc_id, trim(regexp_replace(lower(strip_accents(nfc_normalize(text))), '\\s+', ' ', 'g')) as key "
    "from documents"
)
def text_normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", match_key(F.col("text")).alias("key"))


_LOW = "lower(text)"


@query(
    f"""select doc_id, case when contains({_LOW}, 'the') then 1 else 0 end as seen,
    case when contains(replace({_LOW}, 'ther', 'remote'), 'remote') then 'remote'
      when contains(replace({_LOW}, 'und', 'hybrid'), 'hybrid') then 'hybrid' else '' end as mode,
    case when contains(replace({_LOW}, 'ther', 'remote'), 'remote') then 'remote'
      when contains(replace({_LOW}, 'und', 'hybrid'), 'hybrid') then 'hybrid'
      when contains({_LOW}, 'que') then 'on-site' else '' end as site_mode from documents"""
)
def work_modes(spark, sf):
    low = F.lower("text")
    marked = F.replace(F.replace(low, F.lit("ther"), F.lit("remote")), F.lit("und"), F.lit("hybrid"))
    sited = F.replace(marked, F.lit("que"), F.lit("on site"))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.contains(low, F.lit("the")), 1).otherwise(0).alias("seen"),
        work_mode(marked).alias("mode"),
        work_mode_with_site(sited).alias("site_mode"),
    )


@query(
    r"""select p_partkey,
    regexp_extract(raw_at, '^(.*) at (.*)$', 1) as at_title, regexp_extract(raw_at, '^(.*) at (.*)$', 2) as at_company,
    p_type as hiring_title, p_brand as hiring_company, p_name as colon_title, p_brand as colon_company
    from (select *, p_name || ' at ' || p_type || ' at ' || p_brand as raw_at from part)"""
)
def title_split(spark, sf):
    part = table(spark, sf, "part")
    at = F.concat_ws(" at ", "p_name", "p_type", "p_brand")
    hiring = F.concat_ws(" is hiring ", "p_brand", "p_type")
    colon = F.concat(F.col("p_brand"), F.lit(" : "), F.col("p_name"))
    (t1, c1), (t2, c2), (t3, c3) = title_at_company(at), title_at_company(hiring), company_colon_title(colon)
    return part.select(
        "p_partkey", t1.alias("at_title"), c1.alias("at_company"), t2.alias("hiring_title"),
        c2.alias("hiring_company"), t3.alias("colon_title"), c3.alias("colon_company"),
    )


@query(
    """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as mail_iso,
    strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S') as day_iso,
    date_diff('day', cast(ts as date), date '2024-02-01') - case when cast(ts as time) > time '06:00:00' then 1 else 0 end as age
    from events"""
)
def date_normalise(spark, sf):
    events = table(spark, sf, "events").withColumns(
        {
            "_mail": F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
            "_long": F.date_format("ts", "MMMM d, yyyy"),
        }
    )
    read = with_iso(with_iso(events, "_mail", "mail_iso", RUN.day), "_long", "day_iso", RUN.day)
    moment = wall_clock(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    age = age_in_days(moment, datetime(2024, 2, 1, 6)).cast("bigint")
    return read.select("event_id", "mail_iso", "day_iso", age.alias("age"))


@query(
    f"""select doc_id, score from ({SCORED}) where score >= 20 and status = 'new' and contains(lower(location), 'remote')
    and coalesce(cast(nullif(posted_date, '') as date), first_seen) >= {RUN_DAY} - 30"""
)
def posting_board_query(spark, sf):
    # a board reads scores that a run has stored
    scored = Scratch(spark, "board").save(score(postings(spark, sf).drop("score"), PREFS, RUN), "scored")
    rows = scored.withColumn("id", F.col("doc_id"))
    chosen = PostingFilter(min_score=20, location="Remote", within_days=30, status="new")
    return posting_board(rows, chosen, RUN.day).select("doc_id", "score")


@query(
    f"""select id, title, o_totalprice, row_number() over (partition by first_seen order by o_totalprice desc, id) as place
    from ({_ORDERS_SQL})"""
)
def snapshot_ordered(spark, sf):
    """The order of the stored document; a row's place in it is told inside its day."""
    ordered = snapshot_order(select(spark, sf, ORDERS), "o_totalprice")
    return positions(ordered, "first_seen", "place").select("id", "title", "o_totalprice", "place")


@query(
    f"""select id, title, status, cast(first_seen as varchar) as first_seen, '' as location, 0 as score from ({_ORDERS_SQL})"""
)
def postings_export_rows(spark, sf):
    """The stored document as JSON lines (tests/test_runs.py checks its order)."""
    path = Scratch(spark, "export").path("postings")
    rows = conform(select(spark, sf, ORDERS), POSTING).withColumns({"score": F.lit(0), "location": F.lit("")})
    export_postings(rows, path)
    read = spark.read.schema(POSTING).json(path)
    return read.select("id", "title", "status", F.col("first_seen").cast("string").alias("first_seen"), "location", "score")


@query(f"select count(*) as stored, count(*) filter (where is_new) as new, (select count(*) from ({_ORDERS_SQL})) as rows from ({_UPSERTED})")
def run_totals(spark, sf):
    stored, incoming = _orders(spark, sf)
    merged = upsert_postings(stored, incoming)
    every = select(spark, sf, ORDERS).agg(F.count("*").alias("rows"))
    return health.run_totals(merged).withColumn("rows", every.scalar())


@query("select id, title, company from (" + _ORDERS_SQL + ") where id = '77'")
def point_lookup(spark, sf):
    return by_id(select(spark, sf, ORDERS), "77").select("id", "title", "company")


@query(
    """select 'doc' as source, case when trim(split_part(text, chr(10), 1)) = '' then 'no title'
    when length(text) < 50 then 'too short' end as reason, count(*) as n from documents
    where trim(split_part(text, chr(10), 1)) = '' or length(text) < 50 group by all"""
)
def reject_counts(spark, sf):
    from gleanery.sources import landing

    rows = table(spark, sf, "documents").select(
        F.lit("doc").alias("source"), F.col("doc_id").alias("seq"), "text"
    )
    reason = F.when(F.trim(F.substring_index("text", "\n", 1)) == "", "no title").when(
        F.length("text") < 50, "too short"
    )
    return landing.reject_counts(landing.rejects(rows, reason))
