"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's words are what lies between blanks, A-Z lower-cased; its shingles are all runs
of ``WORDS`` words joined by one space (a shorter text is one shingle). A fingerprint bit is
1 when it is set in over half of the shingles' XXH64 hashes; no words give fingerprint zero.
Fingerprints link when they differ in at most ``MOST`` bits, and documents of linked
fingerprints belong together, through any number of links.

1. Documents become (doc_id, fingerprint); equal fingerprints fold into one node, so copies
   never meet each other.
2. Five bands cut the 64 bits. Two fingerprints that differ in four bits agree in one band
   at least, so every link lies inside a band's value. Nodes are dealt by range over (band
   value, Gray rank): a hot value is spread over as many tasks as its size asks for.
3. Each task reads its range in Gray order and cuts it into chunks of bounded size. A chunk
   is an index tree: a leaf holds neighbours in Gray order, every tree node the bits on
   which all below it agree. Pairs of tree nodes are pruned whole when those common bits
   already differ in more than ``MOST`` places; what is left goes one level down.
   A chunk gives one row per node that is linked to another one of the chunk (a star), not
   its pairs.
4. Values cut into several chunks compare their chunks pairwise by the same trees, one row
   per surviving chunk pair.
5. Stars are joined into components by alternating large-star and small-star rounds, each
   cut by a written table.

Nulls and odd rows: a null text has no words; a null doc_id gets a fingerprint and links
others, but is never a component_id (null if a component has no other id); repeated rows are
reported once each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common

WORDS = 4
MOST = 4
SEED = 42
CHUNK = 4096
LEAF = 32
FAN = 16
PAIRS = 2048

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    parts = text.translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begins = np.concatenate([[0], ends[: len(parts) - words] + 1]).tolist()
    ends = ends[words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(begins), 1 << 16):
        some = zip(begins[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in some], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, raw: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; with ``raw`` also the hash of the text as it is."""
    more = ["raw"] if raw else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            marks = [fingerprint(t, words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found = pa.array(np.array(marks, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found, *map(batch.column, more)], ["doc_id", "fp", *more])

    body = common.whole(docs[text])
    hashed = [F.xxhash64(body).alias(name) for name in more]
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), body.alias("text"), *hashed).mapInArrow(
        run, ", ".join(f"{name} long" for name in ("doc_id", "fp", *more))
    )


# --- the index of one chunk -------------------------------------------------------------


def _levels(marks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the top to the leaves: common bits that are set, and the mask of common bits. Leaves hold ``LEAF`` marks."""
    pad = -len(marks) % LEAF
    each = np.concatenate([marks, np.repeat(marks[-1:], pad)]).reshape(-1, LEAF)
    ones, zeros = np.bitwise_and.reduce(each, axis=1), np.bitwise_and.reduce(~each, axis=1)
    out = [(ones, ones | zeros)]
    while len(ones) > FAN:
        pad = -len(ones) % FAN
        ones = np.bitwise_and.reduce(np.concatenate([ones, np.repeat(ones[-1:], pad)]).reshape(-1, FAN), axis=1)
        zeros = np.bitwise_and.reduce(np.concatenate([zeros, np.repeat(zeros[-1:], pad)]).reshape(-1, FAN), axis=1)
        out.append((ones, ones | zeros))
    return out[::-1]


def _survivors(a: list, b: list, most: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may hold a link: differences accumulate from the top nodes down."""
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a[0][0])), np.arange(len(b[0][0])), indexing="ij"))
    depth = max(len(a), len(b))
    for level in range(depth):
        la, lb = min(level, len(a) - 1), min(level, len(b) - 1)
        if level:
            grow_a, grow_b = level < len(a), level < len(b)
            down_a = np.arange(FAN) if grow_a else np.zeros(1, int)
            down_b = np.arange(FAN) if grow_b else np.zeros(1, int)
            i = (i[:, None, None] * (FAN if grow_a else 1) + down_a[None, :, None] + np.zeros((1, 1, len(down_b)), int)).ravel()
            j = (j[:, None, None] * (FAN if grow_b else 1) + down_b[None, None, :] + np.zeros((1, len(down_a), 1), int)).ravel()
            real = (i < len(a[la][0])) & (j < len(b[lb][0]))
            i, j = i[real], j[real]
        if same:
            upper = i <= j
            i, j = i[upper], j[upper]
        differ = np.bitwise_count((a[la][0][i] ^ b[lb][0][j]) & a[la][1][i] & b[lb][1][j])
        near = differ <= most
        i, j = i[near], j[near]
    return i, j


def _links(a: np.ndarray, b: np.ndarray | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked marks, in slices of bounded size; with ``b`` None inside ``a``, each pair once."""
    other = a if b is None else b
    if len(a) * len(other) <= PAIRS:
        i, j = np.nonzero(np.bitwise_count(a[:, None] ^ other[None, :]) <= most)
        yield (i[i < j], j[i < j]) if b is None else (i, j)
        return
    left, right = _levels(a), _levels(other)
    p, q = _survivors(left, right, most, b is None)
    inner = np.arange(LEAF)
    for at in range(0, len(p), PAIRS):
        i = np.minimum(p[at : at + PAIRS, None] * LEAF + inner, len(a) - 1)
        j = np.minimum(q[at : at + PAIRS, None] * LEAF + inner, len(other) - 1)
        n, x, y = np.nonzero(np.bitwise_count(a[i][:, :, None] ^ other[j][:, None, :]) <= most)
        i, j = i[n, x], j[n, y]
        yield (i[i < j], j[i < j]) if b is None else (i, j)


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels (each its smallest position) after the links (i, j)."""
    while True:
        li, lj = labels[i], labels[j]
        differ = li != lj
        if not differ.any():
            return labels
        i, j, li, lj = i[differ], j[differ], li[differ], lj[differ]
        np.minimum.at(labels, np.maximum(li, lj), np.minimum(li, lj))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def stars(a: np.ndarray, b: np.ndarray | None = None, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(mark, mark it hangs on) for every mark linked to an earlier one; marks are distinct and in Gray order."""
    marks = a if b is None else np.concatenate([a, b])
    labels = np.arange(len(marks))
    for i, j in _links(a, b, most):
        if len(i):
            labels = _merge(labels, i, j if b is None else j + len(a))
    hung = np.flatnonzero(labels != np.arange(len(marks)))
    return marks[hung], marks[labels[hung]]


# --- the distributed self-join ----------------------------------------------------------


def gray_rank(fp: Column) -> Column:
    """Position of a bit pattern in Gray order (as a signed long)."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp


def _bands(fp: Column, most: int) -> Column:
    """One number per band: which band, and its bits."""
    count = most + 1
    width = -(-64 // count)
    if width > 24:
        raise ValueError("at least two differing bits")
    parts = []
    for k in range(count):
        size = min(width, 64 - k * width)
        value = F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        parts.append(value + F.lit(k << width).cast("long"))
    return F.array(*parts)


_CHUNKED = "a long, b long, key long, ones long, mask long, marks binary"


def _chunks(most: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the chunk being filled: its key, whether its key began with it, its marks
        held_key, part, held = None, False, np.zeros(0, np.uint64)
        first = True

        def close(key, marks, cut):
            """Rows of a finished chunk: its stars and, if its key may go on elsewhere, the chunk itself."""
            a, b = stars(marks, None, most)
            rows = [(a.view(np.int64), b.view(np.int64))]
            whole = None
            if cut:
                ones, zeros = np.bitwise_and.reduce(marks), np.bitwise_and.reduce(~marks)
                whole = (int(key), int(ones.view(np.int64)), int((ones | zeros).view(np.int64)), marks.astype("<u8").tobytes())
            return rows, whole

        def batch_of(done):
            a = np.concatenate([r[0] for d in done for r in d[0]]) if done else np.zeros(0, np.int64)
            b = np.concatenate([r[1] for d in done for r in d[0]]) if done else np.zeros(0, np.int64)
            whole = [d[1] for d in done if d[1] is not None]
            nothing = [None] * len(a)
            empty = [None] * len(whole)
            columns = [
                pa.array(a.tolist() + empty, pa.int64()), pa.array(b.tolist() + empty, pa.int64()),
                *(pa.array(nothing + [w[k] for w in whole], pa.binary() if k == 3 else pa.int64()) for k in range(4)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "key", "ones", "mask", "marks"])

        for batch in batches:
            keys = batch.column("key").to_numpy()
            marks = batch.column("fp").to_numpy().view(np.uint64)
            done = []
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else []
            for at, to in zip(edges[:-1], edges[1:], strict=True):
                key, own = int(keys[at]), marks[at:to]
                if held_key is not None and key != held_key:
                    done.append(close(held_key, held, part or first))
                    held_key, part, held, first = None, False, held[:0], False
                held_key = key
                held = np.concatenate([held, own])
                while len(held) > chunk:
                    done.append(close(held_key, held[:chunk], True))
                    part, held = True, held[chunk:]
            if done:
                yield batch_of(done)
        if held_key is not None:
            yield batch_of([close(held_key, held, True)])

    return run


def _across(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = stars(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), most)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def links(nodes: DataFrame, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect what the distinct fingerprints in ``nodes.fp`` connect at ``most`` differing bits."""
    store = common.scratch(nodes, "simhash-links")
    dealt = (
        nodes.select("fp", F.explode(_bands(F.col("fp"), most)).alias("key"), gray_rank(F.col("fp")).alias("rank"))
        .repartitionByRange("key", "rank")
        .sortWithinPartitions("key", "rank")
    )
    found = store.save(dealt.select("key", "fp").mapInArrow(_chunks(most, chunk), _CHUNKED), "chunks")
    near = found.where(F.col("a").isNotNull()).select("a", "b")
    parts = found.where(F.col("marks").isNotNull())
    several = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # chunks of a key hold disjoint marks, so their hash tells them apart
    parts = store.save(
        parts.join(several, "key", "left_semi").select("key", F.xxhash64("key", "marks").alias("chunk"), "ones", "mask", "marks"), "parts"
    )
    x, y = (parts.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("chunk", "ones", "mask"))) for s in "xy")
    differ = F.bit_count(F.col("ones_x").bitwiseXOR(F.col("ones_y")).bitwiseAND(F.col("mask_x")).bitwiseAND(F.col("mask_y")))
    pairs = store.save(
        x.join(y, "key").where((F.col("chunk_x") < F.col("chunk_y")) & (differ <= most)).select("chunk_x", "chunk_y"), "pairs"
    )
    met = pairs.join(parts.select(F.col("chunk").alias("chunk_x"), F.col("marks").alias("x")), "chunk_x").join(
        parts.select(F.col("chunk").alias("chunk_y"), F.col("marks").alias("y")), "chunk_y"
    )
    return near.unionByName(met.select("x", "y").mapInArrow(_across(most), "a long, b long"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the smallest of its component, which is ``root``."""
    store = common.scratch(edges, "components")

    def ordered(pairs: DataFrame) -> DataFrame:
        """Distinct links from the larger to the smaller node."""
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def lowest(pairs: DataFrame) -> DataFrame:
        """The smallest neighbour of each node; stored, so that the join with it can split a hub's links."""
        return store.save(pairs.groupBy("a").agg(F.min("b").alias("low")), "lowest")

    def large_star(pairs: DataFrame) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return both.join(lowest(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b"))

    def small_star(pairs: DataFrame) -> DataFrame:
        low = lowest(pairs)
        moved = pairs.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return moved.unionByName(low.select("a", F.col("low").alias("b")))

    def state(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = store.save(ordered(edges), "links")
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = store.save(ordered(small_star(store.save(ordered(large_star(now)), "large"))), "small")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _named(marked: DataFrame, most: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint in ``marked`` (doc_id, fp)."""
    store = common.scratch(marked, "simhash")
    nodes = store.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    hung = components(links(nodes, most))
    rooted = store.save(
        nodes.join(hung, nodes.fp == hung.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    named = store.save(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
    return rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """One row per document: doc_id, fp, fingerprint (16 hex digits), component_id (smallest doc_id it is linked to)."""
    store = common.scratch(docs, "simhash")
    marked = store.save(fingerprints(docs, doc_id, text), "fingerprints")
    named = store.save(_named(marked, most).drop("root"), "components")
    return marked.join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one document per component, and rows without an id.

    A document is known by its id and the hash of its text as it is. Of a component the
    smallest doc_id stays, and of its texts, if the id has several there, the one with the
    smallest hash. Rows that repeat id and text are one document and stay together.
    """
    store = common.scratch(docs, "simhash-dedup")
    marked = store.save(fingerprints(docs, doc_id, text, raw=True), "fingerprints")
    named = store.save(_named(marked, most), "components")
    found = store.save(marked.where("doc_id is not null").join(named, "fp").select("doc_id", "raw", "root", "component_id"), "found")
    first = found.where("doc_id = component_id")
    texts = first.groupBy("root").agg(F.min("raw").alias("stays"), F.max("raw").alias("last"))
    texts = store.save(texts.where("stays <> last").select("root", "stays"), "texts")
    other = first.join(texts, "root").where("raw <> stays")
    gone = found.where("doc_id <> component_id").select("doc_id", "raw").unionByName(other.select("doc_id", "raw"))
    return common.without(docs, [docs[doc_id].cast("long"), F.xxhash64(common.whole(docs[text]))], gone)
