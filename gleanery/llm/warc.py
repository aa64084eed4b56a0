"""WARC archives: a writer and a splittable reader.

``write`` stores one gzip member per record in ``.warc.gz`` files. Of records with equal
payloads of at least ``SHARE_FROM`` bytes, the one with the smallest page_id is a response,
the others are revisits: HTTP headers and the digest, no payload. Every task attempt writes
files of its own name; the returned manifest, a stored table, lists those of the attempts
that counted, so files of lost executors are never read.

``read`` splits files into byte ranges. A task looks for gzip magic in its range, takes a
candidate as a record only if it inflates to a complete WARC record with sound headers, and
follows the chain from there. It owns the records that start in its range and reads past the
end to finish the last one. Memory is a range and the longest record.

Files are reached through the file system that their URI names, from the tasks only.

Nulls and odd rows: a null payload is empty; a null URL has no target header; a record with
a null page_id is always a response and nobody refers to it; rows that repeat a page_id and
payload are written once each, as their first would be. Damaged bytes are skipped up to the
next sound record. An empty table gives no files and no records. Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import common

SHARE_FROM = 100
RANGE = 4 << 20
FILE = 256 << 20
LEVEL = 4

MAGIC = b"\x1f\x8b\x08"
_BLOCK = 1 << 18
_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """pyarrow file system and path of a URI; a plain path is local."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


# --- one record -------------------------------------------------------------------------


def encode(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = LEVEL) -> bytes:
    """A record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head.append(f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Unsound(ValueError):
    """Not the start of a WARC record."""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise Unsound("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Unsound("no field")
        fields[name.strip().lower()] = value.strip()
    return fields


def decode(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of an inflated record."""
    try:
        head, blank, rest = record.partition(b"\r\n\r\n")
        fields = _fields(head)
        size = int(fields["content-length"])
        if not blank or "warc-type" not in fields or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise Unsound("no complete record")
    except (KeyError, ValueError, UnicodeDecodeError) as e:
        raise Unsound(str(e)) from e
    block, http = rest[:size], {}
    if fields.get("content-type", "").startswith("application/http"):
        front, _, block = block.partition(b"\r\n\r\n")
        for line in front.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            http[name.strip().lower()] = value.strip()
    return fields, http, block


class Window:
    """Bytes of a file from ``begin`` on, read in blocks as they are asked for."""

    def __init__(self, file, begin: int, size: int):
        self.file, self.base, self.size, self.data = file, begin, size, bytearray()

    def reach(self, end: int) -> None:
        end = min(end, self.size)
        while self.base + len(self.data) < end:
            at = self.base + len(self.data)
            got = self.file.read_at(min(max(_BLOCK, end - at), self.size - at), at)
            if not got:
                raise OSError("the file is shorter than listed")
            self.data += got

    def forget(self, before: int) -> None:
        if before - self.base > 4 * _BLOCK:
            del self.data[: before - self.base]
            self.base = before

    def find(self, begin: int, end: int) -> int:
        """First magic that starts in [begin, end), or -1."""
        self.reach(end + len(MAGIC) - 1)
        at = self.data.find(MAGIC, begin - self.base, end - self.base + len(MAGIC) - 1)
        return -1 if at < 0 else self.base + at

    def inflate(self, begin: int) -> tuple[bytes, int]:
        """The member at ``begin`` and where the next one starts. Fails as soon as it can't be a record."""
        unpack, at, out = zlib.decompressobj(31), begin, []
        size, sound = 0, False
        try:
            while not unpack.eof:
                if at >= self.size:
                    raise Unsound("the member does not end")
                self.reach(at + _BLOCK)
                piece = bytes(self.data[at - self.base : at - self.base + _BLOCK])
                out.append(unpack.decompress(piece))
                size += len(out[-1])
                at += len(piece)
                if not sound and size >= 5:
                    if b"".join(out)[:5] != b"WARC/":
                        raise Unsound("no record")
                    sound = True
        except zlib.error as e:
            raise Unsound(str(e)) from e
        return b"".join(out), at - len(unpack.unused_data)


def records(file, size: int, begin: int, end: int) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """The records that start in [begin, end)."""
    window, at = Window(file, begin, size), begin
    while at < end:
        window.forget(at)
        at = window.find(at, end)
        if at < 0:
            return
        try:
            record, after = window.inflate(at)
            yield decode(record)
            at = after
        except Unsound:
            at += 1


# --- tables -----------------------------------------------------------------------------


def assign(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", share_from: int = SHARE_FROM) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of every page; refers_to is null for responses."""
    rows = pages.select(
        pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"), common.whole(pages[html]).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= share_from
    firsts = (
        rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    firsts = common.scratch(pages, "warc").save(firsts.withColumnRenamed("digest", "share"), "firsts")
    # rows that share nothing get a key of their own, so that they don't meet in one task
    rows = rows.withColumn("share", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    return rows.join(firsts, "share", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to")
    )


def write(assigned: DataFrame, folder: str, most: int = FILE, level: int = LEVEL) -> DataFrame:
    """Writes the records and returns the manifest (file, bytes, records) as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name, out, size, count = "", None, 0, 0
        closed = []
        for batch in batches:
            for page, url, payload, digest, refers in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                member = encode(page, url, payload, digest, refers, level)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= most:
                    out.close()
                    closed.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            closed.append((name, size, count))
        if closed:
            names, sizes, counts = zip(*closed, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{n}" for n in names]), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["file", "bytes", "records"]
            )

    manifest = assigned.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "file string, bytes long, records long")
    return common.scratch(assigned, "warc").save(manifest, "manifest")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest (file, bytes) of a folder of archives that others have written."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


_READ = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"


def read(manifest: DataFrame, step: int = RANGE, tasks: int | None = None) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, digest (as written), payload_bytes, payload (null for revisits)."""
    ranges = manifest.where("bytes > 0").select(
        "file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("begin")
    )
    if tasks is None:
        tasks = min(ranges.count(), 100_000) or 1

    def page(value: str | None) -> int | None:
        digits = (value or "").strip("<>").removeprefix(_ID)
        return int(digits) if re.fullmatch(r"-?\d+", digits) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()),
             ("payload_bytes", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for uri, size, begin in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                fs, path = file_system(uri)
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for fields, http, payload in records(file, size, begin, min(begin + step, size)):
                        again = fields["warc-type"] == "revisit"
                        length = int(http.get("content-length", len(payload))) if again else len(payload)
                        rows.append(
                            {
                                "page_id": page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
                                "refers_to": page(fields.get("warc-refers-to")), "payload_bytes": length, "payload": None if again else payload,
                                "digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                            }
                        )
                        held += len(payload)
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.repartition(tasks).mapInArrow(run, _READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    store = common.scratch(pages, "warc")
    return read(write(assign(pages), store.path("archives")))
