"""Fill-in-the-middle by a piece table.

A document becomes descriptors (buffer, start, length) over two immutable buffers: its own
UTF-8 text and the sentinels. Cutting splits descriptors, an arrangement permutes them and
puts sentinels between them, and the inverse permutation restores the text. Texts are copied
once, when an output is read; hashes stream over the descriptors.

The text is cut into units (white space before a word belongs to the word, trailing white
space is a unit of its own). The places of the cuts, the form and the arrangement come from
a hash of seed and doc_id, so a run repeats and no row depends on another one: there is no
shuffle, and a task holds a few MB of text (one text more, if that is longer).

Forms: ``plain`` is the text itself; ``psm`` is <P>prefix<S>suffix<M>middle; ``spm`` is
<S>suffix<P>prefix<M>middle. A text that holds a sentinel stays plain, so the sentinels of
an output are those that were put in, and ``restore`` needs output and form only.

Nulls and odd rows: a null text is empty and an empty text stays plain with no units; a null
doc_id is hashed as an empty one and returned as null; repeated rows are treated alike; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import common

SEED = 42
RATE = 50  # of 100 texts, how many are rearranged
SPM_SHARE = 80  # of 100 rearranged texts, how many have the suffix first
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_SENTINELS = (PREFIX, SUFFIX, MIDDLE)
# An arrangement: which part comes at each place (0 prefix, 1 middle, 2 suffix), and the sentinel before it.
ARRANGEMENTS = {"psm": ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)), "spm": ((2, SUFFIX), (0, PREFIX), (1, MIDDLE))}

TEXT, MARKS = 0, 1
_MARKS = b"".join(_SENTINELS)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Piece:
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over a text and the sentinels; the buffers are never changed."""

    def __init__(self, text: bytes, pieces: tuple[Piece, ...] | None = None):
        self.buffers = (memoryview(text), memoryview(_MARKS))
        self.pieces = pieces if pieces is not None else (Piece(TEXT, 0, len(text)),)

    def _with(self, pieces: tuple[Piece, ...]) -> PieceTable:
        out = object.__new__(PieceTable)
        out.buffers, out.pieces = self.buffers, pieces
        return out

    def cut(self, *places: int) -> PieceTable:
        """Every piece split where a place (in bytes of the whole) falls; one more piece than places."""
        pieces = list(self.pieces)
        for place in sorted(places, reverse=True):
            at = sum(p.length for p in pieces)
            for i in range(len(pieces) - 1, -1, -1):
                p = pieces[i]
                at -= p.length
                if at <= place:
                    head = place - at
                    pieces[i : i + 1] = [Piece(p.buffer, p.start, head), Piece(p.buffer, p.start + head, p.length - head)]
                    break
        return self._with(tuple(pieces))

    def arrange(self, order: tuple[tuple[int, bytes], ...]) -> PieceTable:
        """The pieces in another order, each behind its sentinel."""
        out = []
        for part, mark in order:
            out += [Piece(MARKS, _MARKS.index(mark), len(mark)), self.pieces[part]]
        return self._with(tuple(out))

    def restore(self, order: tuple[tuple[int, bytes], ...]) -> PieceTable:
        """The inverse permutation, without the sentinels."""
        parts = [p for p in self.pieces if p.buffer == TEXT]
        inverse = sorted(range(len(order)), key=lambda place: order[place][0])
        return self._with(tuple(parts[place] for place in inverse))

    def _views(self) -> Iterator[memoryview]:
        for p in self.pieces:
            yield self.buffers[p.buffer][p.start : p.start + p.length]

    def read(self) -> bytes:
        return b"".join(self._views())

    def digest(self) -> str:
        """SHA-256 of the whole, without putting it together."""
        sha = hashlib.sha256()
        for view in self._views():
            sha.update(view)
        return sha.hexdigest()


def unit_ends(text: bytes) -> np.ndarray:
    """Where the units of a UTF-8 text end, in bytes."""
    white = _WHITE[np.frombuffer(text, np.uint8)]
    if not len(white):
        return np.zeros(0, np.int64)
    last = np.append(white[1:], True)
    ends = np.flatnonzero(~white & last) + 1
    return np.append(ends, len(text)) if white[-1] else ends


def parsed(output: bytes, form: str) -> PieceTable:
    """The piece table of an output: its descriptors lie over the output itself."""
    order = ARRANGEMENTS[form]
    starts, at = [], 0
    for _, mark in order:
        at = output.index(mark, at) + len(mark)
        starts.append(at)
    ends = [s - len(m) for s, (_, m) in zip(starts[1:], order[1:], strict=True)] + [len(output)]
    return PieceTable(output, tuple(Piece(TEXT, a, b - a) for a, b in zip(starts, ends, strict=True)))


def _characters(piece: bytes | memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(piece, np.uint8) & 0xC0) != 0x80)) if len(piece) else 0


@dataclass(frozen=True)
class Choice:
    units: int
    form: str
    table: PieceTable
    prefix_chars: int | None = None
    middle_chars: int | None = None


def transformed(text: bytes, ident: int | None, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> Choice:
    ends = unit_ends(text)
    table = PieceTable(text)
    hashed = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hashed[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(ends)
    if not text or h3 % 100 >= rate or any(mark in text for mark in _SENTINELS):
        return Choice(n, "plain", table)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (int(ends[k - 1]) if k else 0 for k in (a, b))
    form = "spm" if h4 % 100 < spm_share else "psm"
    parts = table.cut(first, second)
    return Choice(n, form, parts.arrange(ARRANGEMENTS[form]), _characters(text[:first]), _characters(text[first:second]))


_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
     ("pieces", _PIECES), ("output_sha256", pa.string()), ("output", pa.string())]
)


def transform(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE
) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (null if plain),
    pieces (the descriptors: buffer 0 is the UTF-8 text, 1 the sentinels), output_sha256, output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            columns: list[list] = [[] for _ in _OUT]
            for ident, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                c = transformed(body, ident, seed, rate, spm_share)
                pieces = [{"buffer": p.buffer, "start": p.start, "length": p.length} for p in c.table.pieces]
                row = (ident, c.units, c.form, c.prefix_chars, c.middle_chars, pieces, c.table.digest(), c.table.read())
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            output = pa.array(columns.pop(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=False)), output], schema=_OUT)

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), common.whole(docs[text]).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
        "pieces array<struct<buffer: int, start: long, length: long>>, output_sha256 string, output string",
    )


def restore(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``rows`` with ``text``, rebuilt from output and form alone, and its ``text_sha256``.

    The other columns travel along, whatever their names; ``text`` and ``text_sha256`` are replaced.
    """
    kept = [c for c in rows.columns if c not in ("text", "text_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "_output"):
            texts, hashes = [], []
            for body, kind in zip(batch.column("_output").cast(pa.binary()).to_pylist(), batch.column("_form").to_pylist(), strict=True):
                body = body or b""
                table = parsed(body, kind).restore(ARRANGEMENTS[kind]) if kind in ARRANGEMENTS else PieceTable(body)
                texts.append(table.read())
                hashes.append(table.digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(hashes, pa.string())], ["_row", "text", "text_sha256"]
            )

    packed = rows.select(F.struct(*kept).alias("_row"), rows[output].alias("_output"), rows[form].alias("_form"))
    out = T.StructType([packed.schema["_row"], T.StructField("text", T.StringType()), T.StructField("text_sha256", T.StringType())])
    return packed.mapInArrow(run, out).select("_row.*", "text", "text_sha256")
