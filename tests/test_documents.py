"""JSON documents in ranges: equal to a whole parse wherever the ranges begin; broken ones fail."""

import json
import random
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.plans.snapshot import import_postings
from gleanery.settings import Run
from gleanery.sources import documents as D
from gleanery.sources.documents import _cut, _measure, read_items


RUN = Run(datetime(2026, 6, 30, 12))
WORDS = ["a", "{", "}", "[", "]", '"', "\\", '{"jobs": [', "null", "é漢", "\n", ",", "\\\\\"", "}]"]


@pytest.fixture(params=[700, 1 << 20])
def ranges(spark, request):
    """Ranges of some hundred bytes, so that strings, keys and items are cut anywhere."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "1")
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


def items_of(seed, n):
    rng = random.Random(seed)

    def text(most):
        return "".join(rng.choice(WORDS) for _ in range(rng.randint(0, most)))

    out = []
    for i in range(n):
        row = {"id": f"i{i % (n - 3)}", "title": text(12), "description": text(300 if i == 5 else 30), "tags": [text(3) for _ in range(i % 3)], "source": "own"}
        if i % 4 == 0:
            row["extra"] = {"deep": [{"jobs": [{"id": "no"}]}, [], {}]}
        out.append(row)
    return out


def documents(rows):
    other = {"jobs": [{"id": "inner"}], "list": [{"a": [1, {"b": 2}]}]}
    yield rows
    yield {"jobs": rows}
    yield {"meta": other, "names": [{"id": "x"}, "jobs", 1], "note": 'a{jobs": [', "jobs": rows, "after": [{"id": "y"}, [{"id": "z"}]], "end": {"jobs": {}}}


def test_items_equal_a_whole_parse(spark, tmp_path, ranges):
    rows = items_of(ranges, 16)
    for n, document in enumerate(documents(rows)):
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps(document, indent=n or None, ensure_ascii=n == 1), encoding="utf-8")
        items, single = read_items(spark, str(path), "jobs")
        got = [json.loads(r.text) for r in items.orderBy("file", "start", "seq").collect()]
        assert got == rows and single == []


def read_in_ranges(data, size, key="jobs"):
    """What the tasks and the running sums do, without Spark: pieces by the range that they begin in."""
    by_range, at = {}, 0
    for piece in data.split(b"{"):
        by_range.setdefault(at // size * size, []).append(piece)
        at += len(piece) + 1
    placed = [(start, piece) for start, pieces in by_range.items() for piece in pieces]

    def batch(**more):
        names = {"file": ["f"] * len(placed), "start": [p[0] for p in placed], **more, "piece": [p[1] for p in placed]}
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "piece" else None) for k, v in names.items()})

    told = next(_measure(iter([batch()]))).to_pylist()
    begins, inside, depth = {}, 0, 0
    base = 1 if told[0]["opener"] == "[" else 2
    for r in told:
        begins[r["start"]] = (inside, depth)
        depth += r["quoted"] if inside else r["plain"]
        inside ^= r["flips"]
    assert (inside, depth) == (0, 0)
    own = [begins[p[0]] for p in placed]
    rows = [r for b in _cut(key)(iter([batch(inside=[o[0] for o in own], depth=[o[1] for o in own], base=[base] * len(own))])) for r in b.to_pylist()]
    items, inherited, current = [], None, None
    for r in rows:
        if r["start"] != current:
            current, before = r["start"], inherited
        section = before if r["section"] is None else r["section"]
        if r["kind"] == "end":
            inherited = section
        elif section == key:
            assert r["kind"] != "broken", r
            if r["kind"] in ("item", "head"):
                items.append(r["text"])
            elif r["kind"] == "tail":
                items[-1] += r["text"]
    return items


@pytest.mark.parametrize("size", [1, 7, 20, 64, 500, 10**6])
def test_any_range_size(size):
    for seed in range(8):
        rows = items_of(seed, 20)
        for n, document in enumerate(documents(rows)):
            data = json.dumps(document, indent=seed % 3 or None, ensure_ascii=n == 1).encode()
            assert [json.loads(x) for x in read_in_ranges(data, size)] == rows


def test_many_tasks_read_one_document(spark, tmp_path, ranges):
    (tmp_path / "d.json").write_text(json.dumps({"jobs": items_of(1, 30)}))
    pieces = spark.read.option("lineSep", "{").text(str(tmp_path / "d.json"))
    size = (tmp_path / "d.json").stat().st_size
    assert pieces.rdd.getNumPartitions() >= min(4, size // ranges)
    got = import_postings(spark, str(tmp_path), RUN)
    want = {r["id"]: r["title"].strip() for r in items_of(1, 30)}  # the last of an id
    assert {r.id: (r.title or "").strip() for r in got.collect()} == want


def test_nulls_blanks_and_empty_arrays(spark, tmp_path, ranges):
    texts = ["[]", " [ ] \n", '{"jobs": []}', "[null]", "[null, null]", '{"jobs": null}', "{}", "", '{"jobs": [null], "x": 1}']
    for n, text in enumerate(texts):
        (tmp_path / f"{n}.json").write_text(text)
    assert import_postings(spark, str(tmp_path), RUN).count() == 0
    one = tmp_path / "some"
    one.mkdir()
    (one / "a.json").write_text('\n[null , {"id": "a", "tags": null} , null,\n{"id": "b"}, null ]\n')
    (one / "b.json").write_text('{"id": "alone", "title": "T"}')
    (one / "c.json").write_bytes(b'\xef\xbb\xbf{"jobs":[{"id":"c"}]}')
    assert {r.id for r in import_postings(spark, str(one), RUN).collect()} == {"a", "b", "alone", "c"}


BROKEN = [
    '[{"id": "a"}', '{"jobs": [{"id": "a"}]', '[{"id": "a"', '[{"id": "a}]', '[{"id": "a"} {"id": "b"}]', '[{"id": "a"}, 5, {"id": "b"}]',
    '[{"id": "a"}, "x{y", {"id": "b"}]', '[[{"id": "a"}]]', '{"jobs": [{"id": "a"}, ["b"]]}', '[{"id": "a"},]', '[{"id": "b"]}', '{"jobs": [{"id": "a"}, [{"id": "b"}]]}',
    '[{"id": "a", "tags": {"x": 1}}]', '[{"id": a}]', '[,{"id": "a"}]', "]["
]


@pytest.mark.parametrize("text", BROKEN)
def test_broken_documents_fail(spark, tmp_path, text):
    path = tmp_path / "d.json"
    path.write_text(text)
    with pytest.raises(Exception):  # noqa: B017 - ours or the parser's
        import_postings(spark, str(path), RUN).select(F.to_json(F.struct("*")).alias("row")).collect()


def test_broken_documents_fail_in_small_ranges(spark, tmp_path, ranges):
    filler = ", ".join(json.dumps(r) for r in items_of(3, 8))
    for n, text in enumerate((f"[{filler}", f"[{filler}, 7, {filler}]", f'{{"jobs": [{filler} {filler}]}}', f'{{"x": [7, {{}}], "jobs": [{filler}, [{filler}]]}}')):
        path = tmp_path / f"{n}.json"
        path.write_text(text)
        with pytest.raises(ValueError):
            read_items(spark, str(path), "jobs")


def test_workers_hold_little_however_large_a_range_is(spark, tmp_path, monkeypatch):
    rows = [{"id": f"i{n}", "description": "x" * 3000} for n in range(8000)]
    (tmp_path / "d.json").write_text(json.dumps({"jobs": rows}))
    seen = str(tmp_path / "seen")

    def watched(f):
        def run(batches):
            def told():
                for batch in batches:
                    with open(seen, "a") as out:
                        out.write(f"{batch.nbytes}\n")
                    yield batch

            return f(told())

        return run

    monkeypatch.setattr(D, "_measure", watched(_measure))
    monkeypatch.setattr(D, "_cut", lambda key: watched(_cut(key)))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    items, _ = D.read_items(spark, str(tmp_path / "d.json"), "jobs")
    assert items.count() == 8000
    with open(seen) as told:
        sizes = [int(x) for x in told]
    assert sum(sizes) > 2 * 8000 * 3000 and max(sizes) < 3 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
