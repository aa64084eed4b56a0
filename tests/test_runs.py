"""Whole runs, snapshots, resolution with fusion, states and streams."""

import json
import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gleanery.operators.state import latest_state, merge_state
from gleanery.operators.upsert import upsert_postings
from gleanery.operators.fusion import TRACER
from gleanery.plans.places import places_run, resolve
from gleanery.plans.postings import postings_run
from gleanery.plans.snapshot import SnapshotTable, export_places, export_postings, import_places, import_postings
from gleanery.schema import PLACE, POSTING, RAW, STATE, conform, places_with_nulls
from gleanery.session import Scratch, file_system
from gleanery.settings import Preferences, Run
from gleanery.streaming.ingest import compact as compact_postings
from gleanery.streaming.ingest import pending, read_postings, start_ingest
from gleanery.streaming.states import compact, read_state, start_state_log

RUN = Run(datetime(2026, 6, 30, 12))


def payload(spark, day, *titles):
    jobs = [{"url": f"https://x/{t}", "title": t, "company_name": "C"} for t in titles]
    return spark.createDataFrame([("remotive", 0, 0, day, json.dumps({"jobs": jobs}))], RAW)


def test_postings_run_twice(spark):
    scratch = Scratch(spark, "run")
    snapshots = SnapshotTable(spark, scratch.path("snap"), POSTING, buckets=3)
    prefs = Preferences(strong=("Head",), sources=("remotive", "weworkremotely", "gone"))
    first = postings_run(snapshots, payload(spark, RUN.at, "Head", "Tail"), prefs, RUN, scratch, log_path=scratch.path("log"))
    assert first.stored == 2 and first.removed == 0
    assert {r.name: r.n for r in first.counts.collect()} == {"remotive": 2, "weworkremotely": 0}
    assert first.report.first().subject.startswith("1 new posting on ")
    later = Run(RUN.at + timedelta(days=61))
    second = postings_run(snapshots, payload(spark, later.at, "Next", "Tail"), prefs, later, scratch)
    assert {r.title for r in second.new.collect()} == {"Next"}
    assert second.removed == 2 and [r.title for r in snapshots.read().collect()] == ["Next"]
    assert snapshots.versions() == [1, 2]
    assert snapshots.write(snapshots.read(1), 2) == 2 and snapshots.read(2).count() == 1  # done already


def test_only_the_batch_is_shuffled(spark):
    snapshots = SnapshotTable(spark, Scratch(spark, "snap").path("s"), POSTING, buckets=3)
    rows = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("new").alias("status"))
    snapshots.write(rows)
    batch = conform(rows, POSTING).withColumns({"source_rank": F.lit(0), "seq": F.lit(0).cast("long"), "pos": F.array(F.lit(0))})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = upsert_postings(snapshots.read(), batch, snapshots.buckets)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan
    stored_side = plan[plan.index("FullOuter"):plan.index("FileScan")]
    assert "Exchange" not in stored_side  # fold and layout shuffle the batch, nothing else is


def test_documents(spark, tmp_path):
    rows = [{"id": "a", "title": "1", "source": "s", "extra": 1}, {"id": "a", "title": "2", "source": "s", "first_seen": "2026-01-02"}]
    for name, doc in (("env.json", {"count": 2, "jobs": rows}), ("bare.json", rows)):
        (tmp_path / name).write_text(json.dumps(doc, indent=2))
        got = import_postings(spark, str(tmp_path / name), RUN).collect()
        assert [(r.id, r.title, r.tags, r.status, str(r.first_seen)) for r in got] == [("a", "2", [], "new", "2026-01-02")]
    assert import_postings(spark, str(tmp_path / "none.json"), RUN).count() == 0
    (tmp_path / "p.json").write_text(json.dumps({"restaurants": [{"name": "N", "address": "A", "source": "s", "rating": 0.0}]}))
    place = import_places(spark, str(tmp_path / "p.json"), RUN).first()
    assert place.rating is None and place.cuisine is None and len(place.id) == 16
    export_postings(import_postings(spark, str(tmp_path / "env.json"), RUN), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().title == "2"
    many = spark.range(40).selectExpr("cast(id as string) AS id", "date'2026-01-01' + int(id % 4) AS first_seen", "int(id) AS score", "double(id % 7) AS rating")
    for export, schema, measure in ((export_postings, POSTING, "score"), (export_places, PLACE, "rating")):
        export(conform(many.repartition(5), schema), str(tmp_path / measure))
        lines = [json.loads(x) for f in sorted((tmp_path / measure).glob("part-*")) for x in f.read_text().splitlines()]
        assert len(lines) == 40
        order = [(r["first_seen"], r[measure]) for r in lines]
        assert order == sorted(order, reverse=True)


PRIORITY = ["google_places", "foursquare", "openstreetmap"]


def sequential(rows):
    """The one-by-one loop: exact ids, then similar keys, best source first."""
    rows = sorted((dict(r, tags=list(r["tags"])) for r in rows), key=lambda r: PRIORITY.index(r["source"]) if r["source"] in PRIORITY else 3)

    def absorb(to, row):
        for f in ("phone", "website", "rating"):
            to[f] = to[f] or row[f]
        tag = f"{row['source']}:{row['source_id']}"
        if tag not in to["tags"]:
            to["tags"].append(tag)

    by_id = {}
    for r in rows:
        if r["id"] in by_id:
            absorb(by_id[r["id"]], r)
        else:
            by_id[r["id"]] = r
    out = []
    key = lambda r: f"{r['name']} {r['address']}".lower()
    for r in by_id.values():
        for lead in out:
            if SequenceMatcher(None, key(r), key(lead)).ratio() >= 0.85:
                absorb(lead, r)
                break
        else:
            out.append(r)
    return {r["id"]: (r["name"], r["phone"], r["website"], r["rating"], sorted(r["tags"])) for r in out}


def place_rows(seed, n):
    rng = random.Random(seed)
    names = ["golden dragon", "la piazza", "u fleku", "cafe savoy"]
    rows = []
    for i in range(n):
        name = list(rng.choice(names) + " restaurant")
        for _ in range(rng.randint(0, 4)):
            name[rng.randrange(len(name))] = rng.choice("abcdefgh")
        source = rng.choice([*PRIORITY, "other"])
        sid = f"s{rng.randint(0, n)}"
        rows.append({"id": sid, "name": "".join(name), "address": rng.choice(["praha", "brno 12"]), "source": source, "source_id": sid,
                     "phone": rng.choice([None, f"p{i}"]), "website": rng.choice([None, f"w{i}"]), "rating": rng.choice([None, (i + 1) / 2]),
                     "tags": [f"own{i}"], "source_rank": 0, "seq": i})
    return rows


def test_resolution_equals_the_loop(spark):
    rows = place_rows(11, 70)
    schema = "id string, name string, address string, source string, source_id string, phone string, website string, " \
        "rating double, tags array<string>, source_rank int, seq long"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).withColumn("pos", F.array(F.lit(0)))
    places = places_with_nulls(conform(df.repartition(4), PLACE, "source_rank", "seq", "pos"))
    found = resolve(places, Scratch(spark, "resolve"))
    tags = {}
    for r in found.tags().collect():
        tags.setdefault(r.id, []).append(r.tag)
    got = {r.id: (r["name"], r.phone, r.website, r.rating, sorted(tags[r.id])) for r in found.places.collect()}
    assert got == sequential(rows)
    run = places_run(spark.createDataFrame([], PLACE), spark.createDataFrame([], TRACER), places, RUN, Scratch(spark, "run"))
    assert run.places.where("is_new").count() == len(got)


def test_no_tracer_is_lost(spark):
    """Four places at once, below, at and above where a cap once was."""
    sizes = {"ant": 999, "bee": 1000, "cat": 1001, "dog": 5000}
    rows = None
    for name, copies in sizes.items():
        some = spark.range(copies + 1).select(
            F.lit(name).alias("id"), F.lit(name * 9).alias("name"), F.lit("osm").alias("source"), F.col("id").cast("string").alias("source_id"),
            F.array(F.lit("own")).alias("tags"), F.lit(0).alias("source_rank"), F.col("id").alias("seq"), F.array(F.lit(0)).alias("pos"),
        )
        rows = some if rows is None else rows.unionByName(some)
    places = places_with_nulls(conform(rows, PLACE, "source_rank", "seq", "pos"))
    stored, trace = spark.createDataFrame([], PLACE), spark.createDataFrame([], TRACER)
    for _ in range(2):
        scratch = Scratch(spark, "run")
        run = places_run(stored, trace, places, RUN, scratch)
        stored, trace = scratch.save(run.places.select(*PLACE.names), "next"), scratch.save(run.tracers, "trace")
    assert {r.id: r.tags for r in stored.collect()} == dict.fromkeys(sizes, ["own"])
    told = trace.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("tag").alias("tags")).collect()
    assert {r.id: (r.n, r.tags) for r in told} == {k: (n, n) for k, n in sizes.items()}
    # places that come in without any tag keep their tracers
    bare = places.where("seq = 0").withColumn("tags", F.lit(None).cast("array<string>"))
    assert places_run(stored, trace, bare, RUN, Scratch(spark, "run")).tracers.count() == sum(sizes.values())


def test_layout_of_a_version_may_change(spark):
    root = Scratch(spark, "layout").path("s")
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("new").alias("status"))
    SnapshotTable(spark, root, POSTING, buckets=8).write(rows)
    known = conform(rows.where("id < 1002"), POSTING).withColumns({"source_rank": F.lit(0), "seq": F.lit(0).cast("long"), "pos": F.array(F.lit(0))})
    batch = known.unionByName(known.limit(3).withColumn("id", F.concat(F.lit("n"), "id")))
    tables = len(spark.catalog.listTables())
    for version, buckets in ((2, 4), (3, 16), (4, None)):
        snapshots = SnapshotTable(spark, root, POSTING, buckets=buckets)
        before = snapshots.buckets_of(snapshots.latest())
        merged = upsert_postings(snapshots.read(), batch, before)
        assert snapshots.write(merged, clustered=before) == version
        assert snapshots.buckets_of(version) == (buckets or 16)
        got = snapshots.read(version)
        assert (got.count(), got.select("id").distinct().count()) == (1003, 1003)
    assert len(spark.catalog.listTables()) == tables
    with pytest.raises(ValueError):
        SnapshotTable(spark, root + "x", POSTING).write(rows)


def test_a_finished_version_can_be_run_again(spark):
    scratch = Scratch(spark, "again")
    snapshots = SnapshotTable(spark, scratch.path("snap"), POSTING, buckets=3)
    prefs, raw = Preferences(sources=("remotive",)), payload(spark, RUN.at, "A", "B")
    first = postings_run(snapshots, raw, prefs, RUN, scratch, version=1)
    again = postings_run(snapshots, raw, prefs, RUN, scratch, version=1)
    assert (again.version, again.stored, again.removed) == (first.version, first.stored, first.removed) == (1, 2, 0)
    assert snapshots.versions() == [1]


def test_working_tables_can_be_released(spark):
    with Scratch(spark, "job") as scratch:
        rows, root = scratch.save(spark.range(3), "rows"), scratch.root
        assert rows.count() == 3
    fs, path = file_system(spark, root)
    assert not fs.exists(path)


def test_compaction_keeps_the_state(spark, tmp_path):
    schema = "space string, id string, status string, ts long, arrival long"
    source, log, checkpoint = (str(tmp_path / x) for x in ("in", "log", "cp"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        start_state_log(stream, log, checkpoint).awaitTermination()

    def state():
        return {r.id: (r.status, r.ts) for r in read_state(spark, log).collect()}

    assert compact(spark, log) is None and state() == {}
    arrive(("s", "a", "x", 1, 0), ("s", "b", "x", 1, 1))
    assert compact(spark, log) == 0 and compact(spark, log) == 0
    arrive(("s", "a", "y", 2, 2), ("s", "b", "late", 1, 3))
    assert state() == {"a": ("y", 2), "b": ("x", 1)}
    assert compact(spark, log) == 1
    arrive(("s", "c", "z", 0, 4))
    assert state() == {"a": ("y", 2), "b": ("x", 1), "c": ("z", 0)}


def test_ingest_by_delta(spark, tmp_path):
    prefs = Preferences(strong=("Head",), sources=("remotive",))
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    snapshots = SnapshotTable(spark, str(tmp_path / "snap"), POSTING, buckets=2)

    def arrive(*titles):
        payload(spark, RUN.at, *titles).coalesce(1).write.mode("append").parquet(source)
        raw = spark.readStream.schema(RAW).parquet(source)
        start_ingest(raw, log, prefs, str(tmp_path / "cp"), lambda _: RUN).awaitTermination()

    def titles():
        return sorted(r.title for r in read_postings(snapshots, log, prefs, RUN).collect())

    arrive("Head", "Tail")
    assert titles() == ["Head", "Tail"] and snapshots.versions() == []
    assert compact_postings(snapshots, log, prefs, RUN) == 1
    assert titles() == ["Head", "Tail"] and pending(snapshots, log)[0] == []
    arrive("Head", "More")
    assert titles() == ["Head", "More", "Tail"] and pending(snapshots, log)[0] == [1]
    assert pending(snapshots, log)[1].count() == 2  # a batch holds what came in, not what is stored
    assert compact_postings(snapshots, log, prefs, RUN) == 2 == compact_postings(snapshots, log, prefs, RUN)
    assert [r.score > 0 for r in snapshots.read().where("title = 'Head'").collect()] == [True]


def test_states(spark, tmp_path):
    stored = spark.createDataFrame([("s", "a", "seen", 5), ("s", "b", "seen", 5)], STATE)
    rows = [("s", "a", "applied", 6, 1), ("s", "b", "late", 5, 2), ("s", "c", "x", None, 3), ("s", "c", "y", 0, 4), ("s", "d", "p", 9, 5), ("s", "d", "q", 9, 6)]
    changes = spark.createDataFrame(rows, "space string, id string, status string, ts long, arrival long")
    want = {"a": ("applied", 6), "b": ("seen", 5), "c": ("x", 0), "d": ("p", 9)}
    for parts in (1, 7):
        merged = merge_state(stored, changes.repartition(parts).orderBy(F.rand(parts)))
        assert {r.id: (r.status, r.ts) for r in merged.collect()} == want
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for _ in range(2):  # the second file repeats every change: nothing may move
        changes.coalesce(1).write.mode("append").parquet(source)  # one file: one batch, ties by arrival
        stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(source)
        start_state_log(stream, log, str(tmp_path / "cp")).awaitTermination()
        got = {r.id: (r.status, r.ts) for r in read_state(spark, log).collect()}
        assert got == {r.id: (r.status, r.ts) for r in latest_state(changes).collect()}
