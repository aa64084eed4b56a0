"""Packing by power-of-two decomposition.

A document's tokens (its ids and one end id) are cut into pieces whose lengths are powers of
two: as many pieces of ``most`` tokens as fit, then the binary digits of the rest, largest
first. A piece is a sequence of its own, so no sequence crosses documents and none has
padding; pieces of equal length form a bucket (``write_buckets`` stores them so, each task its
own files), from which batches of equal length are drawn. No row ever meets another one: there
is no shuffle and no group, and a task holds a few MB of text.

Tokens are looked up by piece. The vocabulary's words never contain white space, and in a text
of plain Latin letters, digits and signs they lie within the pieces that the vocabulary cuts a
text into. So each distinct piece is tokenised once and texts are put together from pieces. In
any other text the blank-separated chunks that are not plain go through the whole tokenizer.
Pieces are remembered up to ``REMEMBERED_BYTES`` in two halves: what is used again moves to the
recent half, the older one is forgotten as a whole; very long pieces are not remembered.

Nulls: a null text is empty and has the end id alone; a null doc_id is passed on. Repeated
rows are packed once per row. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import common

MOST = 4096
END = 2
REMEMBERED_BYTES = 64 << 20  # what a worker remembers of pieces and their ids
LONGEST = 256  # characters; a longer piece is not remembered
ENTRY_BYTES = 180  # what is taken for a remembered piece besides its text and ids
TEXTS = 64  # turned into Python strings at a time
BLOCK = 1 << 16  # pieces whose ids are looked up at a time

# How the vocabulary cuts a word, for lower-case Latin letters, digits and ASCII signs.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x00-\x20a-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_CHUNKS = re.compile(r"[^\t-\r ]+")


class _Codes(dict[str, int]):
    """Numbers of pieces. One asked for the first time gets the next number; a very long one a number below zero, for the time being."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.long: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        if len(piece) > LONGEST:
            return self.long.setdefault(piece, -1 - len(self.long))
        self[piece] = code = len(self)
        self.new.append(piece)
        return code


class _Known:
    """Ids of pieces one after another, and where each piece's begin."""

    def __init__(self):
        self.codes = _Codes()
        self.pool, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.bytes = 0

    def add(self, pieces: list[str], ids: list[np.ndarray]) -> None:
        """The ids of pieces that have numbers already, in the order of these."""
        self.pool = np.concatenate([self.pool, *ids])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.bytes += sum(map(len, pieces)) + 4 * sum(map(len, ids)) + ENTRY_BYTES * len(pieces)

    def of(self, pieces: list[str]) -> dict[str, np.ndarray]:
        """The ids of those pieces that are known here."""
        ends = np.cumsum(self.sizes)
        found = ((p, self.codes.get(p)) for p in pieces)
        return {p: self.pool[ends[c] - self.sizes[c] : ends[c]] for p, c in found if c is not None}


class WordIds:
    """Token ids of texts, as unsigned 32-bit integers."""

    _loaded: dict[str, WordIds] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spelling = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.recent, self.older = _Known(), _Known()

    @classmethod
    def load(cls, path: str) -> WordIds:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _tokenized(self, piece: str) -> np.ndarray:
        if piece[0] == "\0":  # a chunk that is not plain
            return np.array(self.tokenizer.encode(piece[1:], add_special_tokens=False).ids, "<u4")
        spelled = piece if piece.isascii() else self.spelling.pre_tokenize_str(piece)[0][0]
        return np.array([t.id for t in self.model.tokenize(spelled)], "<u4")

    @staticmethod
    def _plain(text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and "<|" not in text

    def _pieces(self, text: str) -> list[str]:
        if self._plain(text):
            return _PIECES.findall(text.lower())
        out = []
        for chunk in _CHUNKS.findall(text):
            out += _PIECES.findall(chunk.lower()) if self._plain(chunk) else ["\0" + chunk]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and the number of ids before each text (one more than texts).

        Of the pieces only their numbers are held for all texts, and ids are looked up for ``BLOCK`` pieces at a time.
        """
        if self.recent.bytes > REMEMBERED_BYTES // 2:
            self.older, self.recent = self.recent, _Known()
        now = self.recent
        counts, parts = [0], [np.zeros(0, np.int32)]
        for at in range(0, len(texts), TEXTS):
            for text in texts.slice(at, TEXTS).to_pylist():
                pieces = self._pieces(text)
                parts.append(np.fromiter(map(now.codes.__getitem__, pieces), np.int32, len(pieces)))
                counts.append(len(pieces))
        codes, bounds = np.concatenate(parts), np.cumsum(counts)
        del parts
        new, long = now.codes.new, list(now.codes.long)
        now.codes.new, now.codes.long = [], {}
        again = self.older.of(new)
        now.add(new, [self._tokenized(p) if (known := again.get(p)) is None else known for p in new])
        pool, sizes = now.pool, now.sizes
        if long:  # for this batch alone; number -1 is the last
            extra = list(map(self._tokenized, reversed(long)))
            pool = np.concatenate([pool, *extra])
            sizes = np.concatenate([sizes, np.fromiter(map(len, extra), np.int64, len(extra))])
        begins = np.cumsum(sizes) - sizes
        after = np.concatenate([[0], np.cumsum(sizes[codes])])
        flat = np.empty(after[-1], "<u4")
        for at in range(0, len(codes), BLOCK):
            some = codes[at : at + BLOCK]
            first, last = after[at], after[at + len(some)]
            shift = begins[some] - after[at : at + len(some)]
            flat[first:last] = pool[np.repeat(shift, sizes[some]) + np.arange(first, last)]
        return flat, after[bounds]


def lengths(n: int, most: int = MOST) -> list[int]:
    """The powers of two, at most ``most``, that ``n`` tokens are cut into."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    most: int = MOST,
    end: int = END,
    at_once: int = 8 << 20,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (binary, unsigned 32-bit little-endian), sequence_id, offset.

    A task looks up ``at_once`` bytes of text together: fewer need less memory and more time.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.load(tokenizer)
        last = np.array([end], "<u4").tobytes()
        for batch in common.slices(batches, "text", at_once):
            flat, bounds = words.ids(batch.column("text"))
            owner, start, length, total, ids = [], [], [], [], []
            for row in range(batch.num_rows):
                own = flat[bounds[row] : bounds[row + 1]].tobytes() + last
                n = len(own) // 4
                at = 0
                for size in lengths(n, most):
                    owner.append(row)
                    start.append(at)
                    length.append(size)
                    total.append(n)
                    ids.append(own[4 * at : 4 * (at + size)])
                    at += size
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), common.whole(docs[text]).alias("text"))
    cut_rows = rows.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")
    return cut_rows.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> DataFrame:
    """Store sequences of equal length next to each other, in a folder per length, and read them back."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
    stored = T.StructType([*packed.schema.fields, T.StructField("bucket", T.LongType())])
    return packed.sparkSession.read.schema(stored).parquet(path)
