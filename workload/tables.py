"""Inputs: the benchmark tables seen as postings, places, payloads and changes.

``SELECT`` texts below only rename and combine columns.  The same text runs in Spark and
in the SQL a query is checked with, so both start from equal rows; what an operator does
is written twice, independently.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.session import Scratch
from gleanery.settings import Feedback, Preferences, Run

RUN = Run(datetime(2026, 7, 1, 6, 0))
RUN_DAY = "date '2026-07-01'"

PREFS = Preferences(
    strong=("of the", "ther", "the and"),
    good=("on the", "for", "le"),
    avoid=("und", "with"),
    priority_places=("Prague", "Praha"),
    acceptable_places=("Europe", "Remote"),
    preferred_modes=("remote", "hybrid"),
    contract_types=("full-time", "contract"),
    report_threshold=15,
    report_rows=20,
    feedback=Feedback(("und", "de"), ("company src1", " "), 12, 25),
)

POSTINGS = """
select doc_id as seq, cast(substr(source, 4) as int) as source_rank, source,
  split_part(text, chr(10), 1) as title, 'Company ' || source as company,
  'https://Jobs.example.com/' || source || '/' || lang || cast(n_chars as string) || '/?ref=' || lang as url,
  case lang when 'en' then 'Remote' when 'fr' then 'Prague' when 'es' then 'Europe' else 'Berlin' end as location,
  case n_chars % 3 when 0 then '' when 1 then 'Remote' else 'hybrid' end as remote_type,
  text as description,
  case when n_chars % 11 = 0 then '' else cast(date '2026-05-01' + cast(n_chars % 90 as int) as string) end as posted_date,
  lang, n_chars, doc_id,
  date '2026-04-01' + cast(n_chars % 91 as int) as first_seen,
  case n_chars % 7 when 0 then 'applied' when 1 then 'seen' else 'new' end as status
from {documents}"""

PLACES = """
select 'google_places' as source, 0 as source_rank, c_custkey as seq, c_name as name,
  n_name as address, cast(c_nationkey as string) as group_key, c_mktsegment as neighborhood,
  c_acctbal as rating, cast(c_custkey % 5 as int) as price_level
from {customer} join {nation} on c_nationkey = n_nationkey
union all
select 'openstreetmap' as source, 1 as source_rank, s_suppkey as seq, s_name as name,
  n_name as address, cast(s_nationkey as string) as group_key, '' as neighborhood,
  s_acctbal as rating, cast(s_suppkey % 5 as int) as price_level
from {supplier} join {nation} on s_nationkey = n_nationkey"""

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def select(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """Run a SELECT text on the parquet files (tables in braces)."""
    used = {n: table(spark, sf, n) for n in NAMES if "{" + n + "}" in text}
    return spark.sql(text, **used)


def plain(text: str) -> str:
    """The same text for an engine that knows the tables by name."""
    for name in NAMES:
        text = text.replace("{" + name + "}", name)
    return text


def postings(spark: SparkSession, sf: str) -> DataFrame:
    rows = select(spark, sf, POSTINGS)
    return rows.withColumns(
        {
            "pos": F.array(F.lit(0)),
            "tags": F.array("lang", "source"),
            "posted_ts": F.col("posted_date").try_cast("timestamp_ntz"),
            "salary": F.lit(""),
            "score": F.lit(0),
        }
    )


def positions(ordered: DataFrame, group: str, name: str) -> DataFrame:
    """Each row's position among its group in the order that ``ordered`` has; no task numbers all rows."""
    told = ordered.withColumn("_at", F.monotonically_increasing_id())
    return told.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy("_at")).cast("long")).drop("_at")


def payloads(rows: DataFrame, payload) -> DataFrame:
    """A landing table, one payload per input row."""
    landed = rows.select(
        "source", "source_rank", "seq", F.lit(RUN.at).cast("timestamp").alias("fetched_at"),
        payload.alias("payload"),
    )
    return Scratch(rows.sparkSession, "landing").save(landed, "raw")


WORD = r"[\p{L}\p{N}_]"
BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def strip_sql(expression: str) -> str:
    return f"trim({expression}, {BLANK_SQL})"


def tags_out_sql(expression: str) -> str:
    return f"regexp_replace({expression}, '<[^>]+>', ' ', 'g')"


def plain_sql(expression: str) -> str:
    return strip_sql(tags_out_sql(expression))


def word_sql(expression: str, needles) -> str:
    any_of = "|".join(n.lower() for n in needles)
    return (
        f"regexp_matches({expression}, '(^|[^\\p{{L}}\\p{{N}}_])({any_of})($|[^\\p{{L}}\\p{{N}}_])')"
    )


def id_sql(url: str = "url") -> str:
    return f"substr(sha1(rtrim(split_part(lower({url}), '?', 1), '/')), 1, 16)"


def first_sql(rows: str, keys: str, order: str) -> str:
    return (
        f"select * from (select *, row_number() over (partition by {keys} order by {order}) as rn "
        f"from ({rows})) where rn = 1"
    )
