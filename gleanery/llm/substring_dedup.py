"""Substring dedup: windows of words that occur again, found through a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document. Each word that is covered by a
window whose word sequence also starts anywhere else is removed; windows are judged on the
input, not on what is left.

1. Sketch. Of each window the *anchor* is counted: the smallest-hashed run of
   ``WINDOW - RUNS + 1`` words in it. Equal windows have equal anchors at the same offset, so
   an anchor occurs at least as often as any window it stands for, and there are several
   times fewer anchors than windows. Partition sketches are count-min sketches of ``ROWS``
   rows whose counters stop at two (more is never asked); they are shipped as compressed
   blocks of cells, merged block by block in a stream, and of the merged sketch one bit per
   cell is left: whether its count passed one. Counts are never too small: a window that
   repeats is always estimated repeated.
2. Exact count. Only windows estimated repeated are hashed in full (128 bits over their words)
   and grouped; the counts are combined before the shuffle, so a passage of any number of
   copies is one row per task. What the grouping finds *once* are the wrong estimates, and a
   window that occurs once has one place: the smallest of its group. So the places to take
   back come out of the aggregation itself, and nothing is joined on windows.
3. Removal. Documents meet their wrong estimates (an equi-join by document) and lose the words
   of all other windows estimated repeated.

The sketch has as many cells as the corpus asks for (bytes / 4, a power of two) up to
``MOST_CELLS``, which bounds the broadcast (one bit a cell: 256 MB by default). A larger corpus
fills the sketch, so more windows are estimated repeated and the exact grouping has more to
do; its result stays the same.

Words are runs of characters other than white space and compared unchanged. Nulls and odd rows:
a null text has no words; a null doc_id is passed on; rows that repeat id and text are
documents of their own, so all their windows repeat; documents shorter than a window stay; an
empty table gives no rows. Other columns are ignored. A task holds a few MB of text (one text
more, if that is longer) and works through its words in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common

WINDOW = 35
RUNS = 18  # runs of words in a window that may be its anchor
ROWS = 2
MOST_CELLS = 1 << 31
BLOCK_CELLS = 1 << 18
SHIPPED = 1 << 20  # anchors that a partition sketch holds before it is shipped
WORDS_AT_ONCE = 60_000

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_LONGEST: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread over all positions."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base², … modulo 2^64."""
    key = str(base)
    if key not in _LONGEST or len(_LONGEST[key]) < n:
        steps = np.full(1 << (n - 1).bit_length() if n > 1 else 1, base & (2**64 - 1), np.uint64)
        steps[0] = 1
        _LONGEST[key] = np.multiply.accumulate(steps)
    return _LONGEST[key][:n]


def _sliding(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` over every ``width`` consecutive values, in log2(width) steps."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = of(values[:-step], values[step:])
        done += step
    return values


@dataclass
class Block:
    """Words ``first`` … of a batch of texts: single-spaced bytes, where each word starts and ends in them,
    and at which words a window of one document starts."""

    first: int
    body: bytes
    starts: np.ndarray
    ends: np.ndarray
    whole: np.ndarray

    def anchors(self, window: int, runs: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every run of words, smallest such hash of every window)."""
        raw = np.frombuffer(self.body, np.uint8)
        at = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw)), out=at[1:])
        size = window - runs + 1
        begin, end = self.starts[: len(self.starts) - size + 1], self.ends[size - 1 :]
        inverse = _powers(pow(_BASE, -1, 1 << 64), len(raw))
        hashes = _mixed((at[end] - at[begin]) * inverse[begin])
        return hashes, _sliding(hashes, runs, np.minimum)


@dataclass
class Words:
    """The words of a batch of texts, one after another."""

    body: bytes
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words before each text, one more than texts

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        body = b"\n".join(texts)
        white = _WHITE[np.frombuffer(body, np.uint8)]
        edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        after = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        return cls(body, starts, ends, np.concatenate([[0], np.searchsorted(starts, after)]))

    def blocks(self, window: int) -> Iterator[Block]:
        """Blocks whose windows are all windows; neighbours share ``window - 1`` words."""
        n = len(self.starts)
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))  # where each word's text ends
        for first in range(0, n - window + 1, WORDS_AT_ONCE):
            until = min(first + WORDS_AT_ONCE + window - 1, n)
            whole = np.arange(first, until - window + 1) + window <= last[first : until - window + 1]
            if whole.any():
                body = b" ".join(self.body[self.starts[first] : self.ends[until - 1]].split())
                size = self.ends[first:until] - self.starts[first:until]
                ends = np.cumsum(size + 1) - 1
                yield Block(first, body, ends - size, ends, whole)


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of 2^bits cells."""
    return (_mixed(hashes + np.uint64((_BASE * (row + 1)) & (2**64 - 1))) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Sketch:
    """One bit per cell of a merged sketch: whether its count passed one."""

    bits: int  # a row has 2^bits cells
    rows: list[np.ndarray]

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        """Whether the estimated count of each anchor passes one."""
        out = np.ones(len(hashes), bool)
        for row, plane in enumerate(self.rows):
            cell = cells_of(hashes, row, self.bits)
            out &= (plane[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return out


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), common.whole(docs[text]).alias("text"))
    return rows.withColumn("content", F.xxhash64("text"))


def _shipped(parts: list[np.ndarray], bits: int, width: int) -> Iterator[tuple[int, int, bytes]]:
    """A partition sketch as (row, block of ``width`` cells, cells): sorted, each as often as it was counted but twice at most."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    hashes = np.concatenate(parts)
    for row in range(ROWS):
        cells, counts = np.unique(cells_of(hashes, row, bits), return_counts=True)
        cells = np.repeat(cells, np.minimum(counts, 2))
        cuts = np.flatnonzero(np.diff(cells // width)) + 1
        for own in np.split(cells, cuts):
            block = int(own[0]) // width
            steps = np.diff(own - block * width, prepend=0).astype("<u4")
            yield row, block, packer.compress(steps.tobytes())


def build_sketch(texts: DataFrame, window: int, runs: int, bits: int) -> Sketch:
    """The merged sketch of all anchors."""
    width, shipped = BLOCK_CELLS, SHIPPED

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []

        def ship() -> pa.RecordBatch:
            rows = list(_shipped(parts, bits, width))
            parts.clear()
            row, block, cells = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(block, pa.int32()), pa.array(cells, pa.binary())], ["row", "block", "cells"])

        for batch in common.slices(batches, "text", 4 << 20):
            for b in Words.of(batch.column("text").cast(pa.binary()).to_pylist()).blocks(window):
                hashes, least = b.anchors(window, runs)
                # a run is an anchor if it equals the least of some window of one document that holds it
                bound = np.concatenate([np.zeros(runs - 1, np.uint64), np.where(b.whole, least, 0), np.zeros(runs - 1, np.uint64)])
                parts.append(hashes[hashes <= _sliding(bound, runs, np.maximum)])
            if sum(map(len, parts)) >= shipped:
                yield ship()
        if any(map(len, parts)):
            yield ship()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, now, counts = zstandard.ZstdDecompressor(), None, np.zeros(width, np.uint8)

        def done() -> pa.RecordBatch:
            plane = np.packbits(counts > 1, bitorder="little").tobytes()
            counts[:] = 0
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([plane], pa.binary())], ["row", "block", "plane"])

        for batch in batches:
            for row, block, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and now != (row, block):
                    yield done()
                now = row, block
                own = np.cumsum(np.frombuffer(unpack.decompress(cells), "<u4"), dtype=np.int64)
                twice = own[1:][own[1:] == own[:-1]]
                counts[twice] = 1  # with the next step: two
                counts[own] = np.minimum(counts[own] + np.uint8(1), 2)
        if now is not None:
            yield done()

    parts = texts.select("text").mapInArrow(partial, "row int, block int, cells binary")
    dealt = parts.repartition("row", "block").sortWithinPartitions("row", "block")
    merged = dealt.mapInArrow(merge, "row int, block int, plane binary")
    planes = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
    size = width // 8
    for row in merged.toLocalIterator():  # one bit a cell, MOST_CELLS in all
        plane = np.frombuffer(bytes(row["plane"]), np.uint8)
        planes[row["row"]][row["block"] * size : (row["block"] + 1) * size] = plane[: len(planes[row["row"]])]
    return Sketch(bits, planes)


def _estimated(words: Words, sketch: Sketch, window: int, runs: int) -> Iterator[tuple[Block, np.ndarray]]:
    """Per block, at which of its words a window estimated repeated starts."""
    for b in words.blocks(window):
        _, least = b.anchors(window, runs)
        yield b, np.flatnonzero(b.whole)[sketch.repeated(least[b.whole])]


def wrong_estimates(texts: DataFrame, shared, window: int, runs: int) -> DataFrame:
    """(doc_id, content, starts): windows estimated repeated that occur once, by the number of their first word."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in common.slices(batches, "text", 4 << 20):
            words = Words.of(batch.column("text").cast(pa.binary()).to_pylist())
            for b, found in _estimated(words, shared.value, window, runs):
                if not len(found):
                    continue
                body = b.body
                spans = zip(b.starts[found].tolist(), b.ends[found + window - 1].tolist(), strict=True)
                keys = np.frombuffer(b"".join([xxh3_128_digest(body[s:e]) for s, e in spans]), "<i8").reshape(-1, 2)
                owner = np.searchsorted(words.bounds, b.first + found, side="right") - 1
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch.column("doc_id").take(at), batch.column("content").take(at),
                     pa.array((b.first + found - words.bounds[owner]).astype(np.int64))],
                    ["key_a", "key_b", "doc_id", "content", "start"],
                )

    every = texts.mapInArrow(candidates, "key_a long, key_b long, doc_id long, content long, start long")
    # of a window that occurs once, the least is its own
    counted = every.groupBy("key_a", "key_b").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("content").alias("content"), F.min("start").alias("start")
    )
    return counted.where("n = 1").groupBy("doc_id", "content").agg(F.collect_list("start").alias("starts"))


def _runs(covered: np.ndarray) -> list[dict[str, int]]:
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def size_of(texts: DataFrame, most_cells: int = MOST_CELLS) -> int:
    """Bits of a cell's number in one row: about four cells for each 16 bytes of text, ``most_cells`` at most."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    asked = (max(total // 4, 1) - 1).bit_length()
    least = BLOCK_CELLS.bit_length() - 1
    return max(min(asked, most_cells.bit_length() - 1), least + 1) - (ROWS - 1).bit_length()


def dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    runs: int | None = None,
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """One row per document: doc_id, text (the words kept, one space between), n_words (before), n_removed,
    removed (first and last word of each run that went)."""
    runs = min(RUNS, window) if runs is None else runs
    texts = _texts(docs, doc_id, text)
    sketch = build_sketch(texts, window, runs, size_of(texts, most_cells))
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    wrong = common.scratch(docs, "substring-dedup").save(wrong_estimates(texts, shared, window, runs), "wrong")
    wrong = wrong.select(F.col("doc_id").alias("own_id"), F.col("content").alias("own_content"), "starts")
    same = texts["doc_id"].eqNullSafe(wrong["own_id"]) & (texts["content"] == wrong["own_content"])
    joined = texts.join(wrong.hint("shuffle_hash"), same, "left").select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 4 << 20):
            words = Words.of(batch.column("text").cast(pa.binary()).to_pylist())
            n = len(words.starts)
            windows = np.zeros(n, bool)
            for b, found in _estimated(words, shared.value, window, runs):
                windows[b.first + found] = True
            starts = batch.column("starts")
            once = starts.flatten().to_numpy(zero_copy_only=False)
            if len(once):
                each = np.nan_to_num(starts.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                windows[np.repeat(words.bounds[:-1], each) + once.astype(np.int64)] = False
            cover = np.zeros(n + window, np.int32)
            begins = np.flatnonzero(windows)
            cover[begins] += 1
            cover[begins + window] -= 1
            covered = np.cumsum(cover[:n]) > 0
            kept, spans, removed = [], [], []
            for first, last in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                own = covered[first:last]
                gone = int(np.count_nonzero(own))
                removed.append(gone)
                spans.append(_runs(own) if gone else [])
                if last == first:
                    kept.append(b"")
                    continue
                begin = int(words.starts[first])
                if not gone:
                    kept.append(b" ".join(words.body[begin : int(words.ends[last - 1])].split()))
                    continue
                left, at = [], 0
                for s in [*spans[-1], {"first": last - first, "last": 0}]:
                    if s["first"] > at:
                        left += words.body[int(words.starts[first + at]) : int(words.ends[first + s["first"] - 1])].split()
                    at = s["last"] + 1
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(words.bounds).astype(np.int64)),
                 pa.array(removed, pa.int64()), pa.array(spans, _SPANS)],
                ["doc_id", "text", "n_words", "n_removed", "removed"],
            )

    return joined.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long, removed array<struct<first: long, last: long>>")
