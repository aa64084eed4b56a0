"""Items of large JSON documents: one document is read by many tasks.

A document is an array of objects, or an object that has such an array under a known key. Its
bytes are read in ranges, cut into pieces before every opening brace, so a range needs no more
memory than a piece. Where a range begins inside the document depends on what lies before it:

1. one pass tells for each range how it changes the nesting, once if it began inside a string
   and once if not, and whether it ends in the other of the two;
2. running sums over the ranges of a document (one small row each) give every range its start;
3. a second pass takes the objects at the depth of the items. An object belongs to the range it
   begins in; what it has in later ranges is stored under their numbers and put together by
   an aggregation over these fragments alone.

The pieces between the items are checked too. A document whose brackets or quotes do not close,
or whose array holds anything but objects and nulls, fails the read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.session import Scratch, arrow_batches

_ESCAPED = re.compile(rb"\\.", re.S)
_TOKEN = re.compile(rb'\\.|["\[\]{}]', re.S)
_BETWEEN = re.compile(rb"\s*,\s*(?:null\s*,\s*)*")
_BEFORE_FIRST = re.compile(rb"\s*(?:null\s*,\s*)*")
_AFTER_LAST = re.compile(rb"\s*(?:,\s*null\s*)*")
_NO_ITEM = re.compile(rb"\s*(?:null\s*(?:,\s*null\s*)*)?")
_NAMED = re.compile(rb"\s*:\s*")

#: Bytes of pieces or parts that a Python worker holds at a time; a longer one alone.
_HELD = 2 << 20

#: Text that is in no array of items.
_ELSEWHERE = b""

_RANGE = "file string, start long, flips int, plain long, quoted long, opener string"
_PART = "file string, start long, seq long, kind string, section string, text binary"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start of the range, piece) in the order of the file within a range; the braces are taken away."""
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", "{").text(path)
    return rows.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.col("value").cast("binary").alias("piece"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, bool]]:
    """(range, piece with its brace, whether the range begins) of pieces; only the first of a document has no brace."""
    last: tuple = ()
    for batch in batches:
        piece = batch.schema.get_field_index("piece")
        rest = [batch.column(n).to_pylist() for n in range(batch.num_columns) if n != piece]
        for body, *own in zip(batch.column(piece).to_pylist(), *rest, strict=True):
            fresh = tuple(own) != last
            last = tuple(own)
            yield last, body if fresh and own[1] == 0 else b"{" + body, fresh


def _parts(piece: bytes) -> list[bytes]:
    """What lies outside and inside of strings, in turn."""
    return (_ESCAPED.sub(b"", piece) if b"\\" in piece else piece).split(b'"')


def _opened(parts: list[bytes]) -> int:
    return sum(p.count(b"{") + p.count(b"[") - p.count(b"}") - p.count(b"]") for p in parts)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[list] = []
    for (name, start), piece, fresh in _walk(batches):
        if fresh:
            out.append([name, start, 0, 0, 0, None])
        now, parts = out[-1], _parts(piece)
        now[3] += _opened(parts[now[2] :: 2])
        now[4] += _opened(parts[1 - now[2] :: 2])
        now[2] ^= (len(parts) - 1) & 1
        if start == 0 and not now[5]:
            now[5] = piece.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1") or None
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _RANGE.split(", ")])


def _starts(ranges: DataFrame) -> DataFrame:
    """(file, start, inside, depth, base): whether a range begins inside a string, how deep, and the depth of items."""
    own = Window.partitionBy("file").orderBy("start")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    known = ranges.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    known = known.withColumn("opened", F.when(F.col("inside") == 0, F.col("plain")).otherwise(F.col("quoted")))
    return known.select(
        "file", "start", F.col("inside").cast("int").alias("inside"), F.coalesce(F.sum("opened").over(before), F.lit(0)).alias("depth"),
        F.when(F.first("opener").over(own) == "[", 1).otherwise(2).alias("base"), "opened", "flips",
    )


@dataclass
class _Cutter:
    """Takes the items out of one range, piece by piece."""

    key: bytes
    quoted: bool
    depth: int
    base: int
    #: name of the array that encloses what is read; None: one that an earlier range opened
    section: bytes | None = field(init=False)
    item: list[bytes] | None = None
    kind: str = "item"
    found: list[tuple[str, bytes | None, bytes | None]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.section = _ELSEWHERE
        if self.depth >= self.base:
            self.section = self.key if self.base == 1 else None
        if self.depth > self.base:  # it begins in the middle of an item
            self.item, self.kind = [], "tail"

    def _wanted(self) -> bool:
        return self.section is None or self.section == self.key

    def _check(self, good: re.Pattern[bytes], text: bytes) -> None:
        if self._wanted() and not good.fullmatch(text):
            self.found.append(("broken", self.section, text[:200]))

    def take(self, piece: bytes) -> None:
        if self.depth > self.base:
            parts = _parts(piece)
            outside = parts[self.quoted :: 2]
            if self.depth - sum(p.count(b"}") + p.count(b"]") for p in outside) > self.base:
                if self.item is not None:
                    self.item.append(piece)
                self.depth += _opened(outside)
                self.quoted ^= (len(parts) - 1) & 1 == 1
                return
        self._step(piece)

    def _step(self, piece: bytes) -> None:
        """One token after the other, where items begin and end."""
        begin = gap = 0
        after = True  # of the piece's own item; a piece that begins in an array begins with one
        opened: int | None = None  # where a string at the depth of keys begins
        name, named = _ELSEWHERE, 0
        for token in _TOKEN.finditer(piece):
            sign = token[0]
            if sign == b'"':
                if self.depth == 1 and self.base == 2:
                    if self.quoted and opened is not None:
                        name, named = piece[opened : token.start()], token.end()
                    opened = None if self.quoted else token.end()
                self.quoted = not self.quoted
            elif self.quoted or sign[:1] == b"\\":
                continue
            elif sign in (b"{", b"["):
                if self.depth == self.base and self.section != _ELSEWHERE:
                    if sign == b"{" and self._wanted():
                        begin, self.item, self.kind = token.start(), [], "item"
                    elif sign == b"[":
                        self._check(_NO_ITEM, b"[")
                elif self.depth == self.base - 1:
                    owner = self.key if self.base == 1 else name if _NAMED.fullmatch(piece, named, token.start()) else _ELSEWHERE
                    self.section = owner if sign == b"[" else _ELSEWHERE
                    if self.section == self.key:
                        self.found.append(("section", self.section, None))
                    gap, after = token.end(), False
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == self.base:
                    if self.item is not None:
                        self.item.append(piece[begin : token.end()])
                        self._emit("item" if self.kind == "item" else "tail")
                    begin, gap, after = token.end(), token.end(), True
                elif self.depth == self.base - 1:
                    self._check(_AFTER_LAST if after else _NO_ITEM, piece[gap : token.start()])
                    self.section = _ELSEWHERE
        if self.depth > self.base and self.item is not None:
            self.item.append(piece[begin:])
        elif self.depth == self.base:
            self._check(_BETWEEN if after else _BEFORE_FIRST, piece[gap:])

    def _emit(self, kind: str) -> None:
        self.found.append((kind, self.section, b"".join(self.item or [])))
        self.item = None

    def end(self) -> None:
        if self.item is not None:
            self._emit("head" if self.kind == "item" else "tail")
        self.found.append(("end", self.section, None))


def _cut(key: str):
    wanted = key.encode()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in _PART.split(", ")]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, at, seq, rows, size = None, ("", 0), 0, [], 0

        def drain() -> None:
            nonlocal seq, size
            for kind, section, text in cutter.found:
                rows.append((*at, seq, kind, None if section is None else section.decode("utf-8", "replace"), text))
                seq, size = seq + 1, size + len(text or b"")
            cutter.found.clear()

        for (name, start, inside, depth, base), piece, fresh in _walk(batches):
            if fresh:
                if cutter:
                    cutter.end()
                    drain()
                cutter, at, seq = _Cutter(wanted, bool(inside), depth, base), (name, start), 0
            cutter.take(piece)
            drain()
            if size >= _HELD:
                yield batch_of(rows)
                rows, size = [], 0
        if cutter:
            cutter.end()
            drain()
        yield batch_of(rows)

    return run


def _first_files(rows: DataFrame, most: int = 3) -> str:
    return ", ".join(r.file for r in rows.select("file").distinct().limit(most).collect())


def read_items(spark: SparkSession, path: str, key: str) -> tuple[DataFrame, list[str]]:
    """(file, start, seq, text) of the items of the JSON documents at ``path``, and the documents that are
    objects without an array ``key``.

    (start, seq) grows in the order of the document. What is broadcast is one row of some hundred bytes for
    each range (``spark.sql.files.maxPartitionBytes``) or document.
    """
    store = Scratch(spark, "documents")
    pieces = _pieces(spark, path)
    with arrow_batches(spark, _HELD):
        ranges = store.save(pieces.mapInArrow(_measure, _RANGE), "ranges")
    starts = store.save(_starts(ranges), "starts")
    closed = starts.groupBy("file").agg(F.sum("opened").alias("depth"), (F.sum("flips") % 2).alias("inside"))
    broken = _first_files(closed.where("depth <> 0 or inside <> 0"))
    if broken:
        raise ValueError(f"brackets or quotes of a document do not close: {broken}")
    placed = pieces.join(F.broadcast(starts.drop("opened", "flips")), ["file", "start"])
    with arrow_batches(spark, _HELD):
        parts = store.save(placed.select("file", "start", "inside", "depth", "base", "piece").mapInArrow(_cut(key), _PART), "parts")

    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.where("kind = 'end'").select("file", "start", F.last("section", True).over(before).alias("inherited"))
    resolved = parts.where("kind <> 'end'").join(F.broadcast(store.save(ends, "ends")), ["file", "start"])
    resolved = resolved.where(F.coalesce("section", "inherited") == key).select("file", "start", "seq", "kind", "text")
    broken = _first_files(resolved.where("kind = 'broken'"))
    if broken:
        raise ValueError(f"an array of items holds something else: {broken}")

    so_far = Window.partitionBy("file").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, 0)
    fragments = resolved.where("kind in ('head', 'tail')")
    owner = F.last(F.when(F.col("kind") == "head", F.struct("start", "seq")), True).over(so_far)
    owners = fragments.select("file", "start", "seq", "kind").withColumn("owner", owner).drop("kind")
    joined = fragments.join(owners, ["file", "start", "seq"]).groupBy("file", "owner")
    ordered = F.array_sort(F.collect_list(F.struct("start", "seq", F.col("text").cast("string").alias("text"))))
    spanning = joined.agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))
    whole = resolved.where("kind = 'item'").select("file", "start", "seq", F.col("text").cast("string").alias("text"))
    items = whole.unionByName(spanning.select("file", "owner.start", "owner.seq", "text"))
    named = parts.where((F.col("kind") == "section") & (F.col("section") == key)).select("file").distinct()
    others = starts.select("file").distinct().join(named, "file", "left_anti")
    return items, sorted(r.file for r in others.collect())
