"""Alert mails: choose messages, read their bodies, extract the cards."""

from __future__ import annotations

import codecs
from collections.abc import Iterator, Sequence
from datetime import date
from email import message_from_string
from email.message import Message
from email.utils import parsedate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.listing import work_mode_with_site
from gleanery.functions.text import collapse_blanks, text
from gleanery.operators.order import first_wins
from gleanery.settings import Run
from gleanery.sources.landing import finish_postings
from gleanery.sources.markup import alert_cards

LOOKBACK_DAYS = 30

# Lines of a card that are neither title, company nor location.
NOISE = (
    r"(?i)^(view job|see job|view all jobs|apply|easy apply|actively recruiting|"
    r"be an early applicant|promoted|new|saved|\d+\s*(applicants?|connections?)|"
    r"\d+\s*(minutes?|hours?|days?|weeks?|months?)\s*ago)$"
)
LOCATION = r"(?i),|\((remote|hybrid|on-?site)\)"
JOB_LINK = r"/jobs/view/(\d+)"
JOB_URL = "https://www.linkedin.com/jobs/view/"


def candidate_messages(
    mail: DataFrame,
    run: Run,
    domains: Sequence[str] = ("linkedin.com",),
    phrase: str = "linkedin.com",
    processed: DataFrame | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Unread recent messages by sender or by body; with ``cap`` so many, sender matches first.

    ``processed(uid)`` takes the place of marking messages on a mail server.
    """
    sender = F.lower(text(F.col("sender")))
    by_sender = F.lit(False)
    for domain in domains:
        by_sender = by_sender | F.contains(sender, F.lit(domain.lower()))
    by_body = F.contains(F.lower(text(F.col("raw"))), F.lit(phrase.lower()))
    chosen = mail.where(~F.col("seen") & (F.col("received") >= F.date_sub(F.lit(run.day), LOOKBACK_DAYS)))
    chosen = chosen.withColumn("_by_sender", by_sender).where(F.col("_by_sender") | by_body)
    if processed is not None:
        chosen = chosen.join(processed.select("uid").distinct(), "uid", "left_anti")
    chosen = chosen.dropDuplicates(["uid"])
    if cap is not None:
        chosen = chosen.orderBy(F.col("_by_sender").desc(), "uid").limit(cap)
    return chosen.drop("_by_sender")


def _leaves(message: Message) -> Iterator[Message]:
    """Parts that hold content, through multiparts and forwarded messages."""
    pending = [message]
    while pending:
        part = pending.pop()
        inner = part.get_payload()
        if isinstance(inner, list):
            pending += inner[::-1]
        else:
            yield part


def _content(part: Message) -> str:
    """The text of a part; one that travels as it is has been text all along."""
    coding = str(part.get("Content-Transfer-Encoding", "")).strip().lower()
    if coding not in ("base64", "quoted-printable"):
        return str(part.get_payload())
    charset = str(part.get_param("charset") or "utf-8")
    try:
        codecs.lookup(charset)
    except LookupError:
        charset = "utf-8"
    return bytes(part.get_payload(decode=True)).decode(charset, "replace")


def body_and_date(raw: str) -> tuple[str, str | None]:
    """HTML parts if there are any, else the text parts, and the ISO day of the mail."""
    message = message_from_string(raw)
    shown = [p for p in _leaves(message) if p.get_content_disposition() != "attachment"]
    bodies = ""
    for kind in ("text/html", "text/plain"):
        chosen = [_content(p) for p in shown if p.get_content_type() == kind]
        if chosen:
            bodies = "\n".join(chosen)
            break
    sent = parsedate(str(message["Date"] or ""))
    try:
        day = date(*sent[:3]).isoformat() if sent else None
    except ValueError:
        day = None
    return bodies, day


@F.pandas_udf(T.StructType([T.StructField("body", T.StringType()), T.StructField("day", T.StringType())]))
def _read(raws: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([body_and_date(r or "") for r in raws], columns=["body", "day"])


def read_messages(mail: DataFrame) -> DataFrame:
    """(uid, body, day)"""
    return mail.select("uid", _read(F.col("raw")).alias("_m")).select("uid", "_m.*")


def _is_noise(line: Column) -> Column:
    return line.rlike(NOISE)


def alert_rows(bodies: DataFrame) -> DataFrame:
    """One row per (message, job): the first anchor of the job that carries a title."""
    cards = bodies.select(
        "uid", "day", F.posexplode_outer(alert_cards(F.col("body"))).alias("at", "card")
    ).where(F.col("at").isNotNull())
    titled = cards.select(
        "uid", "day", "at",
        F.regexp_extract("card.href", JOB_LINK, 1).alias("job_id"),
        collapse_blanks(F.col("card.title")).alias("title"),
        F.transform("card.lines", collapse_blanks).alias("lines"),
    ).where((F.col("job_id") != "") & (F.length("title") >= 3) & ~_is_noise(F.col("title")))
    first = first_wins(titled, ["uid", "job_id"], ["at"])
    told = first.withColumn(
        "lines",
        F.array_distinct(
            F.filter("lines", lambda s: (s != "") & (s != F.col("title")) & ~_is_noise(s))
        ),
    ).withColumn("location", text(F.get(F.filter("lines", lambda s: s.rlike(LOCATION)), F.lit(0))))
    return told.withColumn(
        "company", text(F.get(F.filter("lines", lambda s: s != F.col("location")), F.lit(0)))
    ).drop("lines")


def linkedin(bodies: DataFrame, run: Run, source_rank: int = 0) -> DataFrame:
    rows = alert_rows(bodies).select(
        F.lit("linkedin").alias("source"),
        F.lit(source_rank).alias("source_rank"),
        F.col("uid").alias("seq"),
        F.array("at").alias("pos"),
        "title", "company", "location",
        F.concat(F.lit(JOB_URL), "job_id", F.lit("/")).alias("url"),
        work_mode_with_site(F.lower("location")).alias("remote_type"),
        F.col("day").alias("posted_date"),
        F.array(F.lit("email-alert"), F.lit("linkedin")).alias("tags"),
    )
    return finish_postings(rows, run, distinct_urls=False)


MAIL_PARSERS = {"linkedin": linkedin}


def mail_alerts(mail: DataFrame, run: Run, source_rank: int = 0, **choice) -> DataFrame:
    """Every registered parser over the chosen messages."""
    bodies = read_messages(candidate_messages(mail, run, **choice))
    parsed = [parse(bodies, run, source_rank) for parse in MAIL_PARSERS.values()]
    out = parsed[0]
    for more in parsed[1:]:
        out = out.unionByName(more)
    return out
