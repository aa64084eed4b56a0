import gzip
import hashlib
import io
import random

import pyarrow as pa
import pytest

from gleanery.llm import warc

COLUMNS = "page_id long, url string, html string, payload string, digest string"
LARGE = "é" * 60
ROWS = [
    (5, "http://a/ x\r\nY: z", LARGE), (3, "http://b/é", LARGE), (9, None, LARGE), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"),
    (None, "n", LARGE), (7, "u", "x" * 300_000), (8, "u", "x" * 300_000), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "z" * 100), (13, "u", "z" * 100),
    (20, "same", LARGE), (20, "same", LARGE), (-4, "u", "q" * 200), (-3, "u", "q" * 200), (30, "u", "WARC/1.1\r\n\r\n" * 20),
]


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((j for j, _, h in rows if j is not None and h == html), default=None)
        again = len(data) >= 100 and i is not None and i > first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], COLUMNS)


@pytest.mark.parametrize("step", [50, 1000, 1 << 20])
def test_round_trip(spark, tmp_path, step):
    manifest = warc.write(warc.assign(pages(spark, ROWS)), f"file://{tmp_path}/w", most=2000)
    assert manifest.count() > 3 and manifest.agg({"records": "sum"}).first()[0] == len(ROWS)
    got = []
    for r in warc.read(manifest, step).collect():
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert hashlib.sha256(r.payload).hexdigest() == r.digest and len(r.payload) == r.payload_bytes
        got.append((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to))
    assert sorted(got, key=str) == brute(ROWS)
    seen = warc.listed(spark, f"{tmp_path}/w")
    assert sorted(map(str, warc.read(seen, step).select("page_id", "digest").collect())) == sorted(
        map(str, warc.read(manifest, step).select("page_id", "digest").collect())
    )


def archive(rng, n=40):
    """Members that hold gzip magic, whole gzip files in their payloads."""
    inner = gzip.compress(b"WARC/1.1\r\nno record", 0)
    members = []
    for i in range(n):
        payload = rng.randbytes(rng.randint(0, 3000)) + warc.MAGIC * rng.randint(0, 5) + (inner if i % 3 == 0 else b"")
        members.append(warc.encode(i, f"u{i}", payload, hashlib.sha256(payload).hexdigest(), None, level=0 if i % 2 else 6))
    return members


@pytest.mark.parametrize("step", [7, 100, 1001, 5000, 1 << 20])
def test_every_record_has_one_owner(step):
    members = archive(random.Random(step))
    data = b"".join(members)
    file = pa.BufferReader(data)
    got = []
    for begin in range(0, len(data), step):
        got += [int(f["warc-record-id"].strip("<>").rpartition(":")[2]) for f, _, _ in warc.records(file, len(data), begin, min(begin + step, len(data)))]
    assert got == list(range(len(members)))


def test_damage_costs_the_damaged_records_only():
    members = archive(random.Random(1), 6)
    members[2] = members[2][:20] + b"\0" * 10 + members[2][30:]
    data = b"junk" + b"".join(members)[:-3]
    got = [f["warc-record-id"] for f, _, _ in warc.records(pa.BufferReader(data), len(data), 0, len(data))]
    assert got == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)]


def test_members_are_plain_gzip():
    data = warc.encode(1, "u", b"abc", "d", None) + warc.encode(2, "u", b"abc", "d", 1)
    text = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    assert text.count(b"WARC/1.1\r\n") == 2 and text.count(b"abc") == 1 and b"WARC-Refers-To: <urn:page:1>" in text


def test_empty_table(spark, tmp_path):
    manifest = warc.write(warc.assign(pages(spark, ROWS[:1]).limit(0)), f"{tmp_path}/w")
    assert manifest.count() == 0 and warc.read(manifest).count() == 0
