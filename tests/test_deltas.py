"""A store of batches against rewriting everything, and runs that fail in between."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.functions.scoring import preference_key, score, score_base, score_stored
from gleanery.operators.fusion import TRACER
from gleanery.operators.retention import retain
from gleanery.operators.upsert import fold_postings
from gleanery.plans import places as P
from gleanery.plans.deltas import STORED, DeltaSnapshots
from gleanery.plans.postings import next_snapshot, postings_run
from gleanery.plans.snapshot import SnapshotTable, envelope
from gleanery.schema import ORDER_COLUMNS, PLACE, POSTING, RAW, conform
from gleanery.session import Scratch, file_system
from gleanery.settings import Preferences, Run

START = datetime(2026, 1, 1, 12)
PREFS = Preferences(strong=("head",), good=("tail",), avoid=("junior",), preferred_modes=("remote",))


def batch(spark, rng, run, ids):
    rows = [
        (f"p{rng.choice(ids)}", f"{rng.choice(['head', 'tail', 'junior', 'x'])} {run.day} {n}", rng.choice(["new", "new", "seen", "applied"]),
         run.day if rng.random() < 0.7 else run.day - timedelta(days=rng.choice([30, 59, 60, 61])), datetime.combine(run.day, datetime.min.time()), 0, n)
        for n in range(len(ids))
    ]
    df = spark.createDataFrame(rows, "id string, title string, status string, first_seen date, posted_ts timestamp_ntz, source_rank int, seq long")
    return fold_postings(conform(df, POSTING, "source_rank", "seq").withColumn("pos", F.array(F.lit(0))))


def shown(df):
    return sorted((r.id, r.title, r.score, str(r.first_seen), r.status) for r in df.collect())


@pytest.mark.parametrize(("ratio", "most"), [(1e9, 99), (1e9, 3), (0.0, 99)])
def test_equals_rewriting_everything(spark, ratio, most):
    """Days apart so that rows leave, come again and are kept by their status; one change of preferences."""
    rng = random.Random(int(most))
    store = DeltaSnapshots(spark, Scratch(spark, "delta").path("s"), buckets=2, fold_ratio=ratio, most_deltas=most)
    scratch, whole = Scratch(spark, "whole"), spark.createDataFrame([], POSTING)
    for n, day in enumerate((0, 20, 45, 70, 95, 140)):
        run, prefs = Run(START + timedelta(days=day)), PREFS if n < 4 else Preferences(strong=("tail",))
        folded = scratch.save(batch(spark, rng, run, range(12)), "folded")
        merged = next_snapshot(whole, folded, prefs, run)
        kept = retain(merged, run.day)
        before, whole = merged.count(), scratch.save(conform(kept, POSTING), "kept")
        version, totals = store.write(folded, prefs, run)
        assert version == n + 1 and totals == {"before": before, "removed": before - whole.count()}
        assert shown(store.read(prefs, run)) == shown(whole)
    kinds = [p.kind for p in store._parts()]
    assert kinds.count("delta") == 6 and (kinds.count("base") == (6 if not ratio else 1 if most > 9 else 2))


def test_a_run_writes_its_batch_only(spark):
    rng, scratch = random.Random(1), Scratch(spark, "bytes")
    store = DeltaSnapshots(spark, scratch.path("s"), buckets=2, fold_ratio=0.5)
    run = Run(START)
    many = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("title"), F.lit("new").alias("status"),
                                      F.lit(run.day).alias("first_seen"), F.lit(0).alias("source_rank"), F.col("id").alias("seq"), F.array(F.lit(0)).alias("pos"))
    store.write(fold_postings(conform(many, POSTING, *ORDER_COLUMNS)), PREFS, run)
    fs, root = file_system(spark, store.root)
    size = lambda: fs.getContentSummary(root).getLength()
    first = size()
    store.write(batch(spark, rng, run, range(10)), PREFS, run)
    assert size() - first < first / 50
    store.write(batch(spark, rng, run, range(10)), PREFS, run, version=2)  # repeated: nothing
    assert store.versions() == [1, 2] and size() - first < first / 50
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.read(PREFS, run)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan
    assert "Exchange" not in plan[plan.index("FullOuter") : plan.index("FileScan")]  # the base is merged in place


def test_equal_preferences_meet_no_text_rule(spark):
    run, rng = Run(START), random.Random(2)
    rows = Scratch(spark, "score").save(batch(spark, rng, run, range(30)), "rows")
    based = score_base(rows, PREFS)
    later = Run(START + timedelta(days=5))
    want = {r.id: r.score for r in score(rows.drop("score"), PREFS, later).collect()}
    for current in (True, False):
        assert {r.id: r.score for r in score_stored(based, PREFS, later, current).collect()} == want
    other = Preferences(strong=("x",))
    assert preference_key(other) != preference_key(PREFS) == preference_key(Preferences(**vars(PREFS)))
    anew = {r.id: r.score for r in score(rows.drop("score"), other, later).collect()}
    assert {r.id: r.score for r in score_stored(based, other, later).collect()} == anew
    store = DeltaSnapshots(spark, Scratch(spark, "plan").path("s"), buckets=2)
    store.write(rows, PREFS, run)
    rules = lambda prefs: "RLIKE" in store.read(prefs, later)._jdf.queryExecution().optimizedPlan().toString().upper()
    assert not rules(PREFS) and rules(other)


def payload(spark, day, *titles):
    jobs = [{"url": f"https://x/{t}", "title": t, "company_name": "C"} for t in titles]
    return spark.createDataFrame([("remotive", 0, 0, day, json.dumps({"jobs": jobs}))], RAW)


def test_runs_on_both_stores_agree(spark):
    scratch = Scratch(spark, "runs")
    stores = SnapshotTable(spark, scratch.path("whole"), POSTING, buckets=2), DeltaSnapshots(spark, scratch.path("delta"), buckets=2, fold_ratio=9.0)
    prefs = Preferences(strong=("Head",), sources=("remotive",))
    for day, titles in ((0, ("Head", "Tail")), (10, ("Next", "Head")), (61, ("Tail", "More")), (65, ("Next",))):
        run = Run(START + timedelta(days=day))
        raw = payload(spark, run.at, *titles)
        got = [postings_run(s, raw, prefs, run, scratch) for s in stores]
        assert len({(r.version, r.stored, r.removed) for r in got}) == 1
        assert sorted(map(str, got[0].new.collect())) == sorted(map(str, got[1].new.collect()))
        assert got[0].report.first() == got[1].report.first()
        assert shown(stores[0].read()) == shown(stores[1].read(prefs, run))
    with pytest.raises(ValueError):
        postings_run(stores[1], raw, prefs, run, scratch, states=spark.createDataFrame([], "id string, status string"))


@pytest.mark.parametrize("kind", ["whole", "delta"])
def test_a_repeated_run_is_logged_once(spark, kind):
    scratch = Scratch(spark, "log")
    store = SnapshotTable(spark, scratch.path("s"), POSTING, buckets=2) if kind == "whole" else DeltaSnapshots(spark, scratch.path("s"), buckets=2)
    prefs, run, log, taken = Preferences(sources=("remotive",)), Run(START), scratch.path("log"), scratch.path("taken")
    for version in (1, 1, None):  # the last one is a run of its own at the same instant
        postings_run(store, payload(spark, run.at, "A", "B"), prefs, run, scratch, log_path=log, processed_path=taken, version=version)
    rows = store.read() if kind == "whole" else store.read(prefs, run)
    told = envelope(spark.read.parquet(log), rows).first()
    assert (told["count"], told.counts) == (2, {"remotive": 2})
    assert spark.read.parquet(log).count() == 2


def test_tracers_of_a_failed_run_are_not_taken(spark, monkeypatch):
    scratch = Scratch(spark, "failed")
    places, traces = SnapshotTable(spark, scratch.path("p"), PLACE, buckets=2), SnapshotTable(spark, scratch.path("t"), TRACER, buckets=2)

    def raw(name):
        found = [{"place_id": name, "name": name * 9, "formatted_address": "street"}]
        nodes = [{"type": "node", "id": len(name), "tags": {"name": name * 9, "addr:city": "street"}}]
        return spark.createDataFrame([("google_places", 0, 0, START, json.dumps({"results": found})), ("openstreetmap", 1, 0, START, json.dumps({"elements": nodes}))], RAW)

    job = lambda name, **more: P.places_job(places, traces, raw(name), ("google_places", "openstreetmap"), Run(START), scratch, **more)
    for version in (None, 1):
        failing = SnapshotTable.write

        def write(self, *args, **kwargs):
            if self is places:
                raise RuntimeError("lost")
            return failing(self, *args, **kwargs)

        monkeypatch.setattr(SnapshotTable, "write", write)
        with pytest.raises(RuntimeError):
            job("ant", version=version)
        monkeypatch.setattr(SnapshotTable, "write", failing)
    assert places.versions() == [] and traces.versions() == [1]
    done = job("beetle")
    assert done.version == 2 and {r.source_id for r in places.read(2).collect()} == {"beetle"}
    assert {(r.id, r.tag) for r in traces.read(2).collect()} == {(places.read(2).first().id, "openstreetmap:node/6")}
    job("wasp", version=1)  # asked for by its number: its tracers are written anew
    assert {r.tag for r in traces.read(1).collect()} == {"openstreetmap:node/4"}
