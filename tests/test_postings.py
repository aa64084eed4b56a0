"""Posting rules: ids, score, upsert, retention, report."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.functions.dates import with_iso, with_wall_clock
from gleanery.functions.display import rating_text
from gleanery.functions.ids import place_id, posting_id
from gleanery.functions.listing import halved_rating, title_at_company
from gleanery.functions.matching import contains_word
from gleanery.functions.scoring import score
from gleanery.functions.text import collapse_blanks, cut, decoded_description, match_key, strip, title_case
from gleanery.operators.board import PlaceFilter, facet, order_places, place_board, shown_of_total
from gleanery.operators.report import report_page, top_new
from gleanery.operators.retention import fresh, retain
from gleanery.operators.upsert import upsert_places, upsert_postings
from gleanery.schema import PLACE, POSTING, conform, places_with_nulls
from gleanery.settings import Feedback, Preferences, Run

RUN = Run(datetime(2026, 6, 30, 12))


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(expression.alias("x")).first().x


def jobs(spark, *rows, **common):
    base = {"id": "1", "title": "", "company": "", "url": "https://example.com/x", "source": "test",
            "location": "", "remote_type": "", "description": "", "posted_date": "", "salary": "",
            "first_seen": RUN.day, "score": 0, "status": "new", "source_rank": 0, "seq": 0}
    full = [{**base, **common, **r} for r in rows]
    schema = "id string, title string, company string, url string, source string, location string, " \
        "remote_type string, description string, posted_date string, salary string, first_seen date, " \
        "score int, status string, source_rank int, seq long"
    df = spark.createDataFrame([tuple(r.values()) for r in full], schema)
    return df.withColumns({"tags": F.array().cast("array<string>"), "pos": F.array(F.lit(0))})


def points(spark, prefs, **job):
    return score(jobs(spark, job).drop("score"), prefs, RUN).first().score


@pytest.mark.parametrize(
    "text, needle, found",
    [("a leadership role", "lead", False), ("a lead role", "lead", True),
     ("incorporated cpotato", "CPO", False), ("we need a cpo", "CPO", True),
     ("élead", "lead", False), ("c++ (dev)", "c++", True), ("x_lead", "lead", False), ("a\\Eb", "a\\Eb", True)],
)
def test_whole_words(spark, text, needle, found):
    assert one(spark, contains_word(F.lower("t"), [needle]), t=text) is found


def test_score_rules(spark):
    assert points(spark, Preferences(strong=("Head of Product",)), title="Head of Product") >= 30
    assert points(spark, Preferences(strong=("Head of Product",)), description="the head of product") == 15
    assert points(spark, Preferences(avoid=("Junior",)), title="Junior Product Manager") < 0
    plain = Preferences(strong=("Engineer",))
    tuned = Preferences(strong=("Engineer",), feedback=Feedback(("sales",), title_keyword_penalty=20))
    assert points(spark, plain, title="Sales Engineer") - points(spark, tuned, title="Sales Engineer") == 20
    company = Preferences(feedback=Feedback(companies=("Crypto Capital", " "), company_penalty=30))
    assert points(spark, company, title="Product Lead", company="Crypto Capital Ltd") == -30
    modes = Preferences(preferred_modes=("remote",))
    assert points(spark, modes, remote_type="Remote") == 10
    assert points(spark, modes, description="remotely") == 5
    assert points(spark, Preferences(contract_types=("contract",)), description="a contractor") == 6


def test_score_by_age(spark):
    days = {2: 8, 7: 4, 8: 0, 30: 0, 31: -5, -3: 8}
    rows = [{"id": str(d), "posted_date": (RUN.at - timedelta(days=d)).isoformat()} for d in days]
    rows += [{"id": "bad", "posted_date": "soon"}, {"id": "none"}]
    got = {r.id: r.score for r in score(jobs(spark, *rows).drop("score"), Preferences(), RUN).collect()}
    assert got == {**{str(d): p for d, p in days.items()}, "bad": 0, "none": 0}


def test_ids(spark):
    none = F.lit("")
    assert one(spark, posting_id(F.lit("https://X.com/a//?q=1"), none, none)) == "0847c140f7b01eaa"
    assert one(spark, posting_id(F.lit("https://x.com/a"), none, none)) == "0847c140f7b01eaa"
    assert one(spark, posting_id(F.lit("https://x.com/a#f"), none, none)) != "0847c140f7b01eaa"
    assert one(spark, posting_id(none, F.lit(" A "), F.lit("B"))) == one(spark, posting_id(none, F.lit("a"), F.lit("b\t")))
    kept = [one(spark, posting_id(F.lit(f"https://x.com/v?id={i}&k=1"), none, none, ["id"])) for i in (1, 2)]
    assert kept[0] != kept[1]
    assert one(spark, place_id(F.lit("p"), none, none)) != one(spark, place_id(none, F.lit("p"), none))


def test_texts(spark):
    assert one(spark, strip(F.lit("　\xa0 a b\x1f\n"))) == "a b"
    assert one(spark, collapse_blanks(F.lit(" a\t b  c "))) == "a b c"
    assert one(spark, cut(F.lit("😀" * 600), 500)) == "😀" * 500
    assert one(spark, decoded_description(F.lit("<p>a &amp; b&nbsp;</p>"))) == "a & b"
    assert one(spark, match_key(F.lit("  Café  ﬁne Ÿ́ "))) == "cafe fine y"
    for word in ("fish-and chips", "o'neil's", "a1b ÉCOLE"):
        assert one(spark, title_case(F.lit(word))) == word.title()
    for raw, want in (("A at B at C", ("A at B", "C")), ("X is hiring Y", ("Y", "X")), ("X Is Hiring Y", ("X Is Hiring Y", ""))):
        title, company = title_at_company(F.lit(raw))
        assert (one(spark, title), one(spark, company)) == want


def test_rating_is_rounded_on_its_binary_value(spark):
    values = [i / 100 for i in range(1, 1001)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", halved_rating(F.col("v")).alias("r"))
    assert {r.v: r.r for r in rows.collect()} == {v: round(v / 2, 1) for v in values}


def test_dates(spark):
    cases = {
        "2026-06-03": "2026-06-03T00:00:00", "2026-06-03T01:02:03Z": "2026-06-03T01:02:03+00:00",
        "2026-06-03 01:02:03.5+02:00": "2026-06-03T01:02:03.500000+02:00",
        "Wed, 03 Jun 2026 06:00:00 +0000": "2026-06-03T06:00:00+00:00",
        "Wed, 3 Jun 2026 06:00 GMT": "2026-06-03T06:00:00+00:00", "June 3, 2026": "2026-06-03T00:00:00",
        "not a date": None, "": None, "31 Feb 2026 00:00:00 GMT": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "d string")
    assert {r.d: r.i for r in with_iso(df, "d", "i", RUN.day).collect()} == cases
    told = with_wall_clock(df, "d", "t", RUN.day).where("d like '%+02:00'").first().t
    assert told == datetime(2026, 6, 3, 1, 2, 3, 500000)  # the offset is dropped


def test_upsert_keeps_first_seen_and_status(spark):
    old = date(2026, 1, 1)
    stored = conform(jobs(spark, {"id": "a", "status": "applied", "title": "x", "first_seen": old},
                          {"id": "b", "status": "new"}, {"id": "c", "title": "left"}), POSTING)
    batch = jobs(spark, {"id": "a", "title": "y"}, {"id": "b", "status": "seen"},
                 {"id": "n", "title": "first", "seq": 1}, {"id": "n", "title": "last", "seq": 2})
    batch = conform(batch, POSTING, "source_rank", "seq", "pos")
    got = {r.id: r for r in upsert_postings(stored, batch.repartition(3)).collect()}
    assert (got["a"].title, got["a"].status, got["a"].first_seen, got["a"].is_new) == ("y", "applied", old, False)
    assert got["b"].status == "seen" and got["c"].title == "left"
    assert got["n"].title == "last" and got["n"].is_new
    again = upsert_postings(conform(upsert_postings(stored, batch), POSTING), batch)
    assert conform(again, POSTING).exceptAll(conform(upsert_postings(stored, batch), POSTING)).isEmpty()


def test_upsert_places_keeps_known_fields(spark):
    schema = "id string, name string, phone string, rating double, last_updated date, source_rank int, seq long"
    def rows(*r):
        df = spark.createDataFrame(list(r), schema).withColumn("pos", F.array(F.lit(0)))
        return places_with_nulls(conform(df, PLACE, "source_rank", "seq", "pos"))
    old = date(2026, 1, 1)
    stored = rows(("a", "A", "1", 3.0, old, 0, 0), ("b", "B", "2", 0.0, old, 0, 1)).drop("source_rank", "seq", "pos")
    batch = rows(("a", "AA", "", 0.0, RUN.day, 0, 0), ("a", "", "9", 0.0, RUN.day, 0, 1), ("c", "C", "", 1.0, RUN.day, 0, 2))
    got = {r.id: (r.name, r.phone, r.rating, r.last_updated) for r in upsert_places(stored, batch, RUN.day).collect()}
    assert got == {"a": ("AA", "9", 3.0, RUN.day), "b": ("B", "2", None, old), "c": ("C", None, 1.0, RUN.day)}


def test_retention_and_freshness(spark):
    ago = lambda n: RUN.day - timedelta(days=n)
    kept = retain(jobs(spark, {"id": "a", "first_seen": ago(60)}, {"id": "b", "first_seen": ago(61)},
                       {"id": "c", "first_seen": ago(61), "status": "interested"}), RUN.day)
    assert {r.id for r in kept.collect()} == {"a", "c"}
    rows = jobs(spark, {"id": "bad", "posted_date": "soon", "first_seen": ago(99)}, {"id": "old", "first_seen": ago(15)},
                {"id": "new", "posted_date": ago(14).isoformat(), "first_seen": ago(99)})
    assert {r.id for r in fresh(rows, RUN.day, 14).collect()} == {"bad", "new"}


def test_report_limits_before_freshness(spark):
    stale = (RUN.day - timedelta(days=20)).isoformat()
    rows = [{"id": f"{i:02}", "score": 100 - i, "seq": i, "posted_date": stale if i % 2 else ""} for i in range(25)]
    top = top_new(jobs(spark, *rows), Preferences(), RUN)
    assert [r.id for r in top.orderBy("seq").collect()] == [f"{i:02}" for i in range(0, 20, 2)]
    sources = spark.createDataFrame([("b", 1), ("a", 0)], "name string, rank int")
    page = report_page(top, 25, sources, "https://x/?a=1&b=2", RUN).first()
    assert page.subject == "10 new postings on Tuesday, June 30"
    assert "Read from a, b" in page.html and "25 stored" in page.html and page.html.count("<li>") == 10 and "a=1&amp;b=2" in page.html
    none = report_page(top.where("false"), 25, sources, "", RUN).first()
    assert none.subject.startswith("No new postings") and "Nothing above" in none.html


def test_board(spark):
    schema = "id string, name string, rating double, review_count int, first_seen date, cuisine array<string>, status string"
    day = RUN.day
    rows = [("1", "Éclair", 4.0, 1, day, ["Thai", ""], "new"), ("2", "zebra", None, 5, day - timedelta(days=1), None, "dismissed"),
            ("3", "Apple", 4.0, None, day - timedelta(days=2), ["Thai"], "new"), ("4", "eclipse", 4.5, 2, day, [], "new")]
    df = conform(spark.createDataFrame(rows, schema), PLACE)
    order = {s: [r.id for r in order_places(df, s).collect()] for s in ("rating", "newest", "name", "reviews")}
    assert order == {"rating": ["4", "1", "3", "2"], "newest": ["1", "4", "2", "3"],
                     "name": ["3", "1", "4", "2"], "reviews": ["2", "4", "1", "3"]}
    assert [(r.value, r.n) for r in facet(df, "cuisine").collect()] == [("Thai", 2)]
    chosen = PlaceFilter(status="hide_dismissed", cuisine="Thai", min_rating=4.0, search=" APP")
    assert [r.id for r in place_board(df, chosen).collect()] == ["3"]
    assert tuple(shown_of_total(df, PlaceFilter(min_rating=4.2)).first()) == (1, 4)


@pytest.mark.parametrize(("rating", "shown"), [(4.25, "4.3"), (4.75, "4.8"), (4.35, "4.3"), (4.45, "4.5"), (0.25, "0.3"), (4.0, "4.0"), (0.0, "-"), (None, "-")])
def test_shown_rating(spark, rating, shown):
    assert one(spark, rating_text(F.lit(rating).cast("double"))) == shown
