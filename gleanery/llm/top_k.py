"""Exact top-k inner-product search over a pivot-distance index.

Vectors become integers, floor(scale * x). A further coordinate gives all of them the length
of the longest (queries get 0 there), so that the largest inner products are the smallest
distances and the triangle inequality holds.

1. Pivots are picked farthest-first from a sample of ``SAMPLE`` vectors (by a hash of the
   id). Every vector is keyed by its nearest pivot and its distance to it, and the index is
   stored in that order, dealt by range, so a crowded pivot spreads over tasks.
2. Queries go out in blocks of ``BLOCK`` (the size that is broadcast), each with a first
   bound: its k-th best score in the sample. Blocks run one after the other; the best lists
   of a block are stored and its broadcast is destroyed before the next one.
3. A task reads the index in Arrow batches and cuts them into annuli of ``RING`` vectors
   around one pivot. |d(query, pivot) - d(vector, pivot)| bounds the distance from below and
   so the score from above. Annuli are opened from the most promising one on; a query leaves
   as soon as the bound of what is left is below its k-th best score so far.
4. Vectors with an integer beyond 2^24 in magnitude ("wide" ones) stay out of the index,
   whose bounds they would make useless. They meet every query, and wide queries meet every
   vector, in a scan: floating point with an error bound tells which products may be among
   the k best, and those are summed as Python integers.
5. The tasks' best lists are merged per query.

Scores are exact: products are summed in floating point only where that is exact, otherwise
as 64-bit integers, or as Python integers if a vector is wide. Bounds get a margin against
rounding. ``score`` is null where it does not fit 64 bits; its rank is exact all the same.

Nulls and odd rows: vectors that are null or hold a null or non-finite component take no
part, nor do null ids; rows that repeat an id are candidates of their own, but not for each
other, and a repeated query id gets the k best over all its rows (of identical rows, k are
enough for that and no more are kept); shorter vectors count as filled up with zeros; equal
scores go to the smaller id; a query with fewer than k candidates gets what there is; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gleanery.llm import common

PIVOTS = 64
SAMPLE = 4096
BLOCK = 16_384
RING = 512
LARGEST = 1 << 24
FOUND = "query_id long, vec_id long, score long, beyond int, exact binary"


def _finite(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x): the rows that take part."""
    numbers = F.transform(vectors[embedding], lambda x: x.cast("double"))
    return vectors.select(vectors[vec_id].cast("long").alias("vec_id"), numbers.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )


def _narrow(scale: int) -> Column:
    return F.forall("x", lambda x: F.abs(x) <= LARGEST / scale)


def _rows(rows: DataFrame, k: int) -> DataFrame:
    """(vec_id, v) as given, but k of identical rows: more can't be seen in k best."""
    copies = rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))
    return copies.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("n")).drop("n")


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: int, k: int) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part and are not wide."""
    rows = _finite(vectors, vec_id, embedding).where(_narrow(scale))
    return _rows(rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v")), k)


def wide(vectors: DataFrame, vec_id: str, embedding: str, scale: int, k: int) -> DataFrame:
    """(vec_id, v): the other rows that take part, unscaled."""
    return _rows(_finite(vectors, vec_id, embedding).where(~_narrow(scale)).select("vec_id", F.col("x").alias("v")), k)


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with the coordinate that gives them all the same length."""
    v = vectors.astype(float)
    return np.column_stack([v, np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    chosen = [0]
    nearest = distances(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)):
        far = int(nearest.argmax())
        if nearest[far] <= 0:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, distances(points, points[far : far + 1])[:, 0])
    return points[chosen]


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exact."""
    if not len(queries) or not len(vectors):
        return np.zeros((len(queries), len(vectors)), np.int64)
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries.astype(float) @ vectors.T.astype(float)).astype(np.int64)
    return queries @ vectors.T


class Best:
    """The k best (score, smaller id first) found so far for each query of a block."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.copy(), k  # no score below a query's floor can be among its k best
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        query, score, ident = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ident)))
        order = np.lexsort((ident, -score, query))
        query, score, ident = query[order], score[order], ident[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.query, self.score, self.id = (x[place < self.k] for x in (query, score, ident))
        full = place == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full])


def search(block: dict, ids: np.ndarray, vectors: np.ndarray, pivot: np.ndarray, far: np.ndarray, best: Best, ring: int) -> None:
    """Looks through one batch of the index, in its order, for all queries of a block."""
    turns = np.flatnonzero(np.diff(pivot)) + 1
    edges = np.unique(np.concatenate([[0], turns, *(np.arange(a, b, ring) for a, b in zip([0, *turns], [*turns, len(pivot)], strict=True)), [len(pivot)]]))
    begin, end = edges[:-1], edges[1:]
    low, high = np.minimum.reduceat(far, begin), np.maximum.reduceat(far, begin)
    to_pivot = block["distance"][:, pivot[begin]]
    gap = np.maximum(0, np.maximum(low - to_pivot, to_pivot - high) - block["margin"])
    most = (block["reach"][:, None] - gap * gap) / 2 + block["slack"]
    for r in np.argsort(-(most - best.floor[:, None]).max(axis=0), kind="stable"):
        open_ = np.flatnonzero(most[:, r] >= best.floor)
        if not len(open_):
            continue
        inside = slice(begin[r], end[r])
        found = scores(block["vectors"][open_], vectors[inside])
        keep = (found >= best.floor[open_][:, None]) & (block["ids"][open_][:, None] != ids[inside][None, :])
        q, v = np.nonzero(keep)
        if len(q):
            best.add(open_[q], found[q, v], ids[inside][v])


def top_k(
    vectors: DataFrame,
    queries: Column | None = None,
    k: int = 5,
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    pivots: int = PIVOTS,
    sample: int = SAMPLE,
    block: int = BLOCK,
    ring: int = RING,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every query; ``queries`` is a condition on ``vec_id``."""
    spark, store = vectors.sparkSession, common.scratch(vectors, "top-k")
    asked = F.pmod("vec_id", F.lit(50)) == 0 if queries is None else queries
    taking = store.save(integers(vectors, vec_id, embedding, scale, k), "integers")
    beyond = store.save(wide(vectors, vec_id, embedding, scale, k), "wide")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    width, longest = taking.agg(F.max(F.size("v")), F.max(square)).first()
    lists, asking = store.path("best"), taking.where(asked)
    spark.createDataFrame([], FOUND).write.parquet(lists)
    if width is not None:
        key = F.xxhash64("vec_id", "v")
        some = taking.orderBy(key, "vec_id").limit(sample).collect()
        known, known_ids = _matrix([r.v for r in some], width), np.array([r.vec_id for r in some])
        centres = farthest_first(lifted(known, longest), pivots)
        index = store.save(_keyed(taking, centres, width, longest).repartitionByRange("pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id"), "index")
        asking, count = _blocks(asking, block)
        asking = store.save(asking, "queries")
        for number in range(count):
            rows = asking.where(F.col("block") == number).collect()
            if rows:
                found, shared = _searched(index, _block(rows, known, known_ids, centres, width, longest, k), k, ring)
                _store(found.withColumns({"beyond": F.lit(0), "exact": F.lit(None).cast("binary")}), shared, lists, k)
    far_width, largest = beyond.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if far_width is not None:
        plain, far = (df.select("vec_id", F.col("v").cast("array<double>").alias("v"), F.lit(by).alias("by")) for df, by in ((taking, 1), (beyond, scale)))
        width = max(far_width, width or 0)
        shift = math.frexp(largest)[1] + scale.bit_length() + 1
        for asks, against in ((plain.where(asked), far), (far.where(asked), far.unionByName(plain))):
            asks, count = _blocks(asks, block)
            asks = store.save(asks, "wide-queries")
            for number in range(count):
                rows = asks.where(F.col("block") == number).collect()
                if rows:
                    _store(*_scanned(against, rows, width, shift, k), lists, k)
    return _ranked(spark.read.schema(FOUND).parquet(lists), k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their ranks."""
    order = F.desc("beyond"), F.desc("score"), F.desc("exact"), "vec_id"
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _store(found: DataFrame, shared: Broadcast, lists: str, k: int) -> None:
    """Adds the best lists of a block to those stored and destroys what was broadcast for them."""
    _ranked(found, k).drop("rank").write.mode("append").parquet(lists)
    shared.destroy()


def _blocks(asking: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Queries with the number of their block, in the order of a hash of the row, and how many blocks there are."""
    count = -(-asking.count() // max(1, block // 2)) or 1
    return asking.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit(7)), F.lit(count))), count


def _keyed(taking: DataFrame, centres: np.ndarray, width: int, longest: float) -> DataFrame:
    """(pivot, far, vec_id, v): nearest pivot and the distance to it; v as bytes of 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v").to_pylist(), width)
            far = distances(lifted(v, longest), centres)
            pivot = far.argmin(axis=1) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pivot, pa.int32()), pa.array(far[np.arange(len(v)), pivot]), batch.column("vec_id"), pa.array([x.tobytes() for x in v.astype("<i4")], pa.binary())],
                ["pivot", "far", "vec_id", "v"],
            )

    return taking.select("vec_id", "v").mapInArrow(run, "pivot int, far double, vec_id long, v binary")


def _block(rows: list, known: np.ndarray, known_ids: np.ndarray, centres: np.ndarray, width: int, longest: float, k: int) -> dict:
    """A block of queries with their distances to the pivots and their first bounds."""
    v, ids = _matrix([r.v for r in rows], width), np.array([r.vec_id for r in rows])
    square = (v.astype(float) ** 2).sum(axis=1)
    floor = np.full(len(v), np.iinfo(np.int64).min)
    for at in range(0, len(v), 512):
        found = scores(v[at : at + 512], known)
        found[ids[at : at + 512][:, None] == known_ids[None, :]] = np.iinfo(np.int64).min
        if found.shape[1] >= k:
            floor[at : at + 512] = np.partition(found, -k, axis=1)[:, -k]
    scale = float(longest + square.max(initial=0)) + 1
    return {
        "ids": ids, "vectors": v, "distance": distances(np.column_stack([v, np.zeros(len(v))]), centres), "reach": square + longest,
        "floor": floor, "margin": 1e-6 * scale**0.5, "slack": 1e-6 * scale,
    }


def _searched(index: DataFrame, block: dict, k: int, ring: int) -> tuple[DataFrame, Broadcast]:
    """The best lists of a block over the index, and what was broadcast for them."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Best(own["floor"], k)
        for batch in batches:
            if batch.num_rows:
                v = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(batch.num_rows, -1).astype(np.int64)
                search(own, batch.column("vec_id").to_numpy(), v, batch.column("pivot").to_numpy(), batch.column("far").to_numpy(), best, ring)
        yield pa.RecordBatch.from_arrays([pa.array(own["ids"][best.query]), pa.array(best.id), pa.array(best.score)], ["query_id", "vec_id", "score"])

    rows = index.select("pivot", "far", "vec_id", "v").mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "vec_id", "score")]))
    return rows, shared


def _whole(v: list, by: int) -> list[int]:
    """floor(by * x) of every component; beyond the range of a float, x is a whole number itself."""
    return [math.floor(x * by) if math.isfinite(x * by) else int(x) * by for x in v]


def _scaled(rows: list[list[int]], width: int, shift: int) -> np.ndarray:
    """Integer vectors over 2^shift, as floats of at most 1 in magnitude."""
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = [math.ldexp(x, -shift) if abs(x) < 1 << 1000 else math.ldexp(x >> 100, 100 - shift) for x in v]
    return out


def sortable(score: int) -> bytes:
    """Bytes in the order of the integers."""
    size = -(-abs(score).bit_length() // 8)
    magnitude = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + magnitude if score >= 0 else b"\x00" + bytes(255 - x for x in magnitude)


def _scan(ids: np.ndarray, queries: np.ndarray, whole: list[list[int]], batches: Iterator[tuple], width: int, shift: int, k: int) -> list[list[tuple]]:
    """For each query its k best (-score, id, lower bound) over (ids, integer vectors) of the batches."""
    best: list[list[tuple]] = [[] for _ in whole]
    floor = np.full(len(whole), -np.inf)
    reach = np.abs(queries).max(axis=1, initial=0)
    for other, vectors in batches:
        floats = _scaled(vectors, width, shift)
        about = queries @ floats.T
        error = 2.0**-50 * (width + 2) ** 2 * reach[:, None] * np.abs(floats).max(axis=1, initial=0)[None, :] + (width + 2) * 2.0**-1060
        apart = ids[:, None] != other[None, :]
        low = np.where(apart, about - error, -np.inf)
        if low.shape[1] >= k:
            floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
        for q, c in zip(*np.nonzero(apart & (about + error >= floor[:, None])), strict=True):
            score = sum(a * b for a, b in zip(whole[q], vectors[c], strict=False))
            best[q].append((-score, int(other[c]), float(low[q, c])))
        for q, found in enumerate(best):
            if len(found) > k:
                found.sort()
                del found[k:]
            if len(found) == k:
                floor[q] = max(floor[q], min(x[2] for x in found))
    return best


def _scanned(against: DataFrame, rows: list, width: int, shift: int, k: int, at_once: int = 512) -> tuple[DataFrame, Broadcast]:
    """The best lists of a block of queries over all of ``against`` (vec_id, v, by), and what was broadcast for them."""
    shared = against.sparkSession.sparkContext.broadcast((np.array([r.vec_id for r in rows]), [_whole(r.v, r.by) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, whole = shared.value

        def pieces():
            for batch in batches:
                for at in range(0, batch.num_rows, at_once):
                    some = batch.slice(at, at_once)
                    v, by = some.column("v").to_pylist(), some.column("by").to_pylist()
                    yield some.column("vec_id").to_numpy(), [_whole(x, n) for x, n in zip(v, by, strict=True)]

        best = _scan(ids, _scaled(whole, width, shift), whole, pieces(), width, shift, k)
        out = []
        for query, found in zip(ids.tolist(), best, strict=True):
            for minus, ident, _ in found:
                fits = -(1 << 63) <= -minus < 1 << 63
                out.append((query, ident, -minus if fits else None, 0 if fits else 1 if minus < 0 else -1, None if fits else sortable(-minus)))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score", "beyond", "exact"])

    return against.mapInArrow(run, FOUND), shared
