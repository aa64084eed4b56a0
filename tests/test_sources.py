"""Readers on small payloads, among them the alert mails and markup fallbacks."""

import json
from datetime import date, datetime
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from gleanery.schema import MAIL, RAW
from gleanery.settings import Run
from gleanery.sources import mail as M
from gleanery.sources.places import google_places, read_places
from gleanery.sources.registry import (
    SOURCES,
    Inputs,
    defined_rejects,
    read_defined,
    read_enabled,
    read_source,
    read_sources,
    register,
)

RUN = Run(datetime(2026, 6, 30, 12))

# A digest as lists in lists: what counts of an entry is told by the rules, not by its layout.
# (number, title, lines below it, expected company, place and mode; None: no posting)
ENTRIES = [
    (7, "Pastelero", ["12 applicants", "Horno Sur"], ("Horno Sur", "", "")),
    (7, "Pastelero otra vez", ["Horno Norte"], None),  # the number came before
    (8, "Qa", ["Kanzlei Nord"], None),  # too short a title
    (9, "APPLY", ["Kanzlei Nord"], None),  # noise in place of a title
    (640, "Glass  blower", ["Oulu, Suomi (remote)", "4 weeks ago", "Lasi Oy"], ("Lasi Oy", "Oulu, Suomi (remote)", "remote")),
    (12, "Vedoucí skladu", ["Vedoucí skladu", "saved"], ("", "", "")),  # its own title is no company
]


def digest(entries):
    shown = []
    for number, title, lines, _ in entries:
        link = f"http://mail.linkedin.com/x?to=/jobs/view/{number}&n={number}"
        shown.append(f"<li><ul>{''.join(f'<li>{x}</li>' for x in [f'<b><a href={json.dumps(link)}>{title}</a></b>', *lines])}</ul></li>")
    return "<h3>Neu heute</h3><ol><li><a href='https://www.linkedin.com/jobs/search'>Everything</a></li>" + "".join(shown) + "</ol>"


ALERT = digest(ENTRIES)
EXPECTED = {number: want for number, _, _, want in ENTRIES if want}


def landed(spark, source, *texts):
    rows = [(source, 0, i, RUN.at, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, RAW)


def ld(block):
    return f'<script type="application/ld+json">{json.dumps(block)}</script>'


def posting(url, **more):
    return {"@type": "JobPosting", "url": url, "title": " T ", **more}


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t, "2026-06-03") for i, t in enumerate(texts)], "uid long, body string, day string")


def test_entries_of_a_digest(spark):
    rows = M.linkedin(bodies(spark, ALERT), RUN).collect()
    assert {r.url: (r.company, r.location, r.remote_type) for r in rows} == {f"{M.JOB_URL}{n}/": want for n, want in EXPECTED.items()}
    assert sorted(r.title for r in rows) == ["Glass blower", "Pastelero", "Vedoucí skladu"]
    assert {(r.posted_ts, r.tags[0]) for r in rows} == {(datetime(2026, 6, 3), "email-alert")}


@pytest.mark.parametrize("order", [(5, 4, 3, 2, 1, 0), (1, 0), (3,), ()])
def test_entries_in_any_order_and_place(spark, order):
    """The first titled link of a number tells its posting; nothing around the list matters."""
    some = [ENTRIES[i] for i in order]
    first = {}
    for number, title, _, _ in some:
        if len(title) > 2 and title != "APPLY":
            first.setdefault(number, title.replace("  ", " "))
    page = f"<div><i>Fwd</i><blockquote>{digest(some)}</blockquote></div>"
    rows = M.linkedin(bodies(spark, "", page, None), RUN).collect()
    assert {(r.seq, r.url, r.title) for r in rows} == {(1, f"{M.JOB_URL}{n}/", t) for n, t in first.items()}


def test_mail_bodies(spark):
    mail = EmailMessage()
    mail["Date"] = datetime(2026, 6, 9, 23, 30)
    mail.set_content("nur Text")
    assert M.body_and_date(mail.as_string()) == ("nur Text\n", "2026-06-09")
    mail.add_alternative(ALERT, subtype="html")
    mail.add_attachment("<p>attached</p>", subtype="html", filename="a.html")
    body, day = M.body_and_date(mail.as_string())
    assert "view/640" in body and "Vedoucí" in body and "nur Text" not in body and "attached" not in body and day == "2026-06-09"
    outer = EmailMessage()
    outer.set_content("see below")
    outer.add_attachment(mail)
    assert "view/12&" in M.body_and_date(outer.as_string())[0]
    assert M.body_and_date("Date: someday\n\nx") == ("x", None)
    assert M.body_and_date("Content-Type: text/plain; charset=klingon\n\nx")[0] == "x"
    assert M.body_and_date("") == ("", None)


def test_choice_of_messages(spark):
    fresh, old = date(2026, 6, 20), date(2026, 5, 1)
    link = "see linkedin.com"
    rows = [(1, "me@x", fresh, False, link), (2, "A@LinkedIn.com", fresh, False, "x"), (3, "a@linkedin.com", old, False, link),
            (4, "a@linkedin.com", fresh, True, link), (5, "me@x", fresh, False, "x"), (6, "a@linkedin.com", fresh, False, "x")]
    mail = spark.createDataFrame(rows + rows[:1], MAIL)
    chosen = M.candidate_messages(mail, RUN, processed=mail.where("uid = 6"))
    assert sorted(r.uid for r in chosen.collect()) == [1, 2]
    assert [r.uid for r in M.candidate_messages(mail, RUN, cap=2).collect()] == [2, 6]
    many = spark.range(150).selectExpr("id AS uid", "'a@linkedin.com' AS sender", "date'2026-06-20' AS received", "false AS seen", "'x' AS raw")
    assert M.candidate_messages(many, RUN).count() == 150


def test_dynamite_cards_only_before_any_result(spark):
    card = '<p><a href="/remote-jobs/7"> Some <b>Role</b></a><a href="/remote-jobs/8"><img></a></p>'
    rows = read_source("dynamitejobs", landed(spark, "dynamitejobs", "<p>x</p>", card, card.replace("7", "9"), ld(posting("u"))), RUN)
    assert {r.url for r in rows.collect()} == {"https://dynamitejobs.com/remote-jobs/7", "u"}
    rows = read_source("dynamitejobs", landed(spark, "dynamitejobs", ld({"@graph": [posting("u")]}) + card, card), RUN)
    assert {r.url for r in rows.collect()} == {"u"}


def test_talent_cards_on_pages_without_postings(spark):
    card = '<div><a href="/en/view?id=1"><h2>Remote <i>PM</i></h2></a><p>Acme•Brno•x</p></div><h2><a href="/q">n</a></h2>'
    item = ld({"@type": "ItemList", "itemListElement": [{"item": posting("u")}, posting("v"), {"@type": "Thing", "url": "w"}]})
    again = ld(posting("u")) + card  # its only posting is known already: the cards count
    rows = {r.url: r for r in read_source("talent_cz", landed(spark, "talent_cz", item + card.replace("=1", "=2"), again), RUN).collect()}
    assert set(rows) == {"u", "v", "https://cz.talent.com/en/view?id=1"}
    found = rows["https://cz.talent.com/en/view?id=1"]
    assert (found.title, found.company, found.location, found.remote_type) == ("RemotePM", "Acme", "Brno•x", "remote")


def test_hydration(spark):
    deep = {"name": "Deep", "url": "/d", "office": "x"}
    for _ in range(40):
        deep = {"k": deep}
    blob = {"a": [{"title": "T", "slug": "s", "link": "/j", "company_name": " C ", "remote": "fulltime", "location": "L"}], "z": deep}
    page = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(blob)}</script>' + ld(posting("u"))
    rows = {r.url: r for r in read_source("welcometothejungle", landed(spark, "welcometothejungle", page, "<script id=__NEXT_DATA__>no</script>"), RUN).collect()}
    assert set(rows) == {"u", "https://www.welcometothejungle.com/j", "https://www.welcometothejungle.com/d"}
    hit = rows["https://www.welcometothejungle.com/j"]
    assert (hit.title, hit.company, hit.remote_type, hit.location) == ("T", "C", "remote", "L")


def test_first_wins_inside_a_source_and_bad_payloads(spark):
    feed = "<rss><channel>" + "".join(
        f"<item><title>{t}</title><link>{u}</link></item>" for t, u in [("A at X", "1"), ("B", "2"), ("C", "1"), ("D", "")]
    ) + "</channel></rss>"
    defs = [{"name": "f", "type": "rss"}, {"name": "j", "type": "json_api", "fields": {"title": "a.b"}}, {"name": "p", "type": "jsonld"}, {"name": "z", "type": "x"}]
    raw = (landed(spark, "f", feed, "<broken", feed.replace("A at X", "Z"))
           .unionByName(landed(spark, "j", '{"data": [{"url": "9", "a": {"b": 5}}, 3, {"url": ""}]}', "{", '{"jobs": 1}'))
           .unionByName(landed(spark, "p", ld(posting("p1", jobLocation=[{"address": {"addressCountry": "CZ"}}], hiringOrganization="x")) + '<script type="application/ld+json">{</script>'))
           .unionByName(landed(spark, "z", "x")))
    rows = {(r.source, r.url): r for r in read_defined(raw.repartition(5), defs, RUN).collect()}
    assert set(rows) == {("f", "1"), ("f", "2"), ("j", "9"), ("p", "p1")}
    assert (rows["f", "1"].title, rows["f", "1"].company, rows["f", "2"].company) == ("A", "X", "—")
    assert rows["j", "9"].title == "5" and rows["p", "p1"].location == "CZ" and rows["p", "p1"].company == "—"
    bad = {(r.source, r.seq): r.reason for r in defined_rejects(raw, defs).collect()}
    assert bad == {("f", 1): "malformed feed", ("j", 1): "malformed JSON", ("j", 2): "no array of postings",
                   ("p", 0): "malformed JSON-LD", ("z", 0): "unknown source type"}


def test_registry(spark):
    register("mine", lambda raw, run: raw.select("source"))
    with pytest.raises(ValueError, match="does not return"):
        read_source("mine", landed(spark, "mine", ""), RUN)
    del SOURCES["mine"]
    body = json.dumps([{"url": "1", "title": " t ", "tags": ["a", "b"]}, {"url": "1", "tags": "x, ,y"}])
    rows = read_sources(["nobody", "workingnomads"], landed(spark, "workingnomads", body), RUN).orderBy("pos").collect()
    assert [r.tags for r in rows] == [["a", "b"], ["x", "y"]] and rows[0].location == "Remote"
    assert rows[0].first_seen == RUN.day and F is not None


def test_enabled_names_without_a_site(spark):
    own = [{"name": "own", "type": "json_api", "fields": {}}]
    raw = landed(spark, "own", '[{"url": "u", "title": "t"}]')
    mail = spark.createDataFrame([(7, "a@linkedin.com", date(2026, 6, 20), False, "Content-Type: text/html\n\n" + ALERT)], MAIL)
    both = read_enabled(("generic", "who", "gmail_alerts"), Inputs(raw, own, mail), RUN)
    assert sorted((r.reader, r.source) for r in both.select("reader", "source").collect()) == [
        ("generic", "own"), *[("gmail_alerts", "linkedin")] * len(EXPECTED),
    ]
    taken = spark.createDataFrame([(7,)], "uid long")
    assert read_enabled(("gmail_alerts",), Inputs(raw, own, mail, taken), RUN).count() == 0
    assert read_enabled(("gmail_alerts",), Inputs(raw), RUN).count() == 0
    assert read_enabled(("generic",), Inputs(raw), RUN).count() == 0
    with pytest.raises(ValueError, match="no known source"):
        read_enabled(("who",), Inputs(raw), RUN)


def test_only_the_sources_of_a_type_are_scanned(spark, tmp_path):
    path = str(tmp_path / "raw")
    landed(spark, "own", "[]").write.parquet(path)
    defs = [{"name": "own", "type": "json_api"}, {"name": "feed", "type": "rss"}]
    plan = read_defined(spark.read.parquet(path), defs, RUN)._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.split("\n") if "PushedFilters" in line]
    assert len(pushed) <= 2 and all("own" in p or "feed" in p for p in pushed)  # no definition of a type: no scan


def test_modes_and_details_of_places(spark):
    found = json.dumps({"results": [{"place_id": "a", "name": "A"}, {"place_id": "b", "name": " "}, {"place_id": "c", "name": "C", "permanently_closed": True}]})
    detail = json.dumps({"result": {"place_id": "a", "name": "A!", "photos": [{"photo_reference": str(i)} for i in range(9)]}})
    node = json.dumps({"elements": [{"type": "node", "id": 1, "tags": {"name": "N"}}]})
    raw = landed(spark, "google_places", found).unionByName(landed(spark, "google_places/details", detail)).unionByName(landed(spark, "openstreetmap", node))
    names = ("openstreetmap", "nobody", "google_places")
    assert {r.name for r in read_places(names, raw, RUN).collect()} == {"A!", "N"}
    daily = read_places(names, raw, RUN, "daily").collect()
    assert [r.name for r in daily] == ["A!"] and len(daily[0].photos) == 9
    assert read_places(("nobody",), raw, RUN).count() == 0


@pytest.mark.parametrize(("source", "scans"), [("welcometothejungle", 1), ("dynamitejobs", 2), ("talent_cz", 2)])
def test_pages_are_not_read_again_and_again(spark, tmp_path, source, scans):
    path = str(tmp_path / "raw")
    landed(spark, source, "<p>x</p>").write.parquet(path)
    plan = read_source(source, spark.read.parquet(path), RUN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == scans


def found_places(spark):
    """Search results of 60 queries that share places, one of them found by all; repeated within a payload too."""
    def result(pid, n):
        return {"place_id": pid, "name": f"{pid} by {n}", "formatted_address": "a"}

    texts = [json.dumps({"results": [result(p, n) for p in (f"p{n % 7}", "hot", f"p{n % 7}", "", None)]}) for n in range(60)]
    details = [json.dumps({"result": result(f"p{n % 3}", f"detail {n}")}) for n in range(20)]
    return landed(spark, "google_places", *reversed(texts)), landed(spark, "google_places/details", *details)


def test_search_results_are_not_sorted_before_they_are_dealt(spark, tmp_path):
    for name, rows in zip(("search", "details"), found_places(spark), strict=True):
        rows.write.parquet(str(tmp_path / name))
    search, details = (spark.read.parquet(str(tmp_path / name)) for name in ("search", "details"))
    plan = google_places(search, details, RUN)._jdf.queryExecution().executedPlan().toString()
    above = []  # (depth, operator) from the root to the line
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [a for a in above if a[0] < depth] + [(depth, line.lstrip(" :+-"))]
        if "FileScan" in line:
            below = [name for _, name in above]
            dealt = max(n for n, name in enumerate(below) if name.startswith("Exchange"))
            assert not [x for x in below[dealt:] if x.startswith(("Sort", "WindowGroupLimit"))]


def test_first_of_each_place_wins(spark):
    got = {r.source_id: (r.name, r.seq) for r in google_places(*found_places(spark), RUN).collect()}
    want = {"hot": ("hot by 59", 0)} | {f"p{n % 7}": (f"p{n % 7} by {n}", 59 - n) for n in range(53, 60)}
    assert got == {k: (f"{k} by detail {k[1]}" if k in ("p0", "p1", "p2") else v[0], v[1]) for k, v in want.items()}


def test_types_without_a_definition_are_not_planned(spark):
    raw = landed(spark, "own", '[{"url": "https://x.example/1", "title": "T"}]')
    rows = read_defined(raw, [{"name": " own ", "type": "JSON_API"}], RUN)
    assert "Union" not in rows._jdf.queryExecution().analyzed().toString()
    assert [r.title for r in rows.collect()] == ["T"]
    for none in ([], [{"name": "own", "type": "other"}]):
        assert read_defined(raw, none, RUN).count() == 0
