"""Line dedup: winnowing over line hashes.

A window is the shortest run of lines from a line on, or up to a line, that has ``WORDS``
words; a run of lines that is shared somewhere else and has as many words is covered by
whole windows. Each window selects the smallest hash among its lines (the last of equals) as fingerprint, so two
copies of a window select the same one: a fingerprint that occurs once rules out all windows
that select it.

1. One pass stores a thin row per window: where it lies, its fingerprint, its own hash.
2. Positions of fingerprints are counted; those that occur again become a bit set of fixed
   size, and only windows of such fingerprints go on.
3. Windows meet their equals through their hash: the smallest position (by doc_id, then
   line) is the first, all others are repeats. Counts and first positions are aggregated
   before the shuffle, and no pair of positions is ever made: each repeat is compared with
   the first occurrence only, however many copies there are.
4. From a repeated window a match reaches to both sides as long as the windows there are
   repeats as well; the lines of these runs are deleted. The line at the earliest place is
   never deleted, so every deleted line survives somewhere. Empty lines between two deleted
   runs go with them.

Lines are compared without regard to the blanks around and between their words. Nulls and
odd rows: a null text is empty (one empty line); documents without an id come last in order;
rows that repeat id and text are the same document and are treated alike; shorter shared
runs stay; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common

WORDS = 50


def windows(text: bytes, least: int = WORDS) -> Iterator[tuple[int, int, int, int, bool]]:
    """(first line, last line, fingerprint, hash, whether the fingerprint's position is new) of every window of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    parts = [line.split() for line in text.split(b"\n")]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    total = np.cumsum(counts)
    if not len(total) or total[-1] < least:
        return
    hashes = np.array([xxh64_intdigest(b" ".join(p)) for p in parts], np.uint64).view(np.int64)
    ranked = np.where(counts > 0, hashes, np.iinfo(np.int64).max)  # an empty line is no fingerprint
    before = total - counts
    full = np.flatnonzero(counts > 0)
    ahead = np.searchsorted(total, before[full] + least)
    back = np.searchsorted(before, total[full] - least, side="right") - 1
    spans = {(a, b) for a, b in zip(full.tolist(), ahead.tolist(), strict=True) if b < len(total)}
    spans |= {(a, b) for a, b in zip(back.tolist(), full.tolist(), strict=True) if a >= 0}
    seen = set()
    for begin, end in sorted(spans):
        own = ranked[begin : end + 1]
        at = end - int(own[::-1].argmin())
        yield begin, end, int(ranked[at]), xxh64_intdigest(hashes[begin : end + 1].tobytes()), at not in seen
        seen.add(at)


def _windows(docs: DataFrame, least: int) -> DataFrame:
    """(doc, first, last, mark, hash, fresh) of all windows; ``doc`` sorts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            owner, rows = [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                found = list(windows(text, least))
                owner += [i] * len(found)
                rows += found
            first, last, mark, whole, fresh = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(owner, pa.int64())) for c in ("late", "doc_id", "content")), pa.array(first, pa.int32()), pa.array(last, pa.int32()),
                 pa.array(mark, pa.int64()), pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(fresh, pa.bool_())],
                ["late", "doc_id", "content", "first", "last", "mark", "hash", "fresh"],
            )

    return docs.select("late", "doc_id", "content", "text").mapInArrow(
        run, "late boolean, doc_id long, content long, first int, last int, mark long, hash long, fresh boolean"
    )


def repeats(docs: DataFrame, least: int = WORDS, words: int = common.FILTER_WORDS) -> DataFrame:
    """(doc_id, content, runs): the runs of lines (first, last) that repeat earlier ones; ``docs`` as made by ``_keyed``."""
    store = common.scratch(docs, "line-dedup")
    every = store.save(_windows(docs, least), "windows")
    again = every.where("fresh").groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = store.save(common.membership_words(again.select(F.xxhash64("mark").alias("key")), "key", words), "marks")
    key = F.xxhash64("mark")
    some = every.withColumn("word", common.member_word(key, words)).join(F.broadcast(shared), "word")
    place = F.struct("late", "doc_id", "content", "first")
    some = store.save(some.where(common.probable_member(key, F.col("mask"), words)).select("hash", place.alias("place"), "last"), "candidates")
    firsts = some.groupBy("hash").agg(F.min("place").alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = some.join(store.save(firsts, "firsts"), "hash").where(F.col("place") > F.col("origin"))
    # per document: its repeated windows, as many as it has lines at most
    return later.groupBy(F.col("place.late").alias("late"), F.col("place.doc_id").alias("doc_id"), F.col("place.content").alias("content")).agg(
        F.collect_set(F.struct(F.col("place.first").alias("first"), "last")).alias("runs")
    )


def merged(runs: list[tuple[int, int]], lines: list[str]) -> list[tuple[int, int]]:
    """Runs that overlap, or have nothing but empty lines between them, joined to maximal ones."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and not any(x.strip() for x in lines[out[-1][1] + 1 : first]):
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), common.whole(docs[text]).alias("text"))
    return rows.withColumns({"late": F.col("doc_id").isNull(), "content": F.xxhash64("text")})


_CLEANED = pa.schema(
    [("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("removed_lines", pa.int64()),
     ("runs", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = WORDS) -> DataFrame:
    """One row per document: doc_id, text without repeated runs, n_lines (before), removed_lines, runs (first and last line of each)."""
    keyed = _keyed(docs, doc_id, text)
    found = common.scratch(docs, "line-dedup").save(repeats(keyed, least), "runs")
    found = found.select("late", F.col("doc_id").alias("own_id"), F.col("content").alias("own_content"), "runs")
    same = keyed["doc_id"].eqNullSafe(found["own_id"]) & (keyed["content"] == found["own_content"])
    joined = keyed.join(found.drop("late").hint("shuffle_hash"), same, "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            out = []
            for ident, body, runs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n, gone = body.count("\n") + 1, []
                if runs:
                    lines = body.split("\n")
                    gone = merged([(r["first"], r["last"]) for r in runs], lines)
                    for first, last in reversed(gone):
                        del lines[first : last + 1]
                    body = "\n".join(lines)
                out.append(
                    {"doc_id": ident, "text": body, "n_lines": n, "removed_lines": sum(b - a + 1 for a, b in gone),
                     "runs": [{"first": a, "last": b} for a, b in gone]}
                )
            yield pa.RecordBatch.from_pylist(out, _CLEANED)

    return joined.mapInArrow(run, "doc_id long, text string, n_lines long, removed_lines long, runs array<struct<first: int, last: int>>")
