"""Centroid clustering over an incremental distance matrix.

Every vector carries its exact integer dot products with all centroids. A round assigns each
vector to the nearest centroid and replaces every non-empty centroid by the componentwise
floor(sum / count) of its vectors. Then only the components that changed count: the dot
product with a centroid grows by the vector's components times their (integer) changes, and a
centroid that stayed costs nothing. Distances are |v|² - 2 v·c + |c|², so the nearest centroid
is an argmin over the carried products; ties go to the smaller number.

A vector takes part if it has exactly ``dim`` components, none null or non-finite; component x
becomes the integer floor(scale * x). The first centroids are the vectors with the smallest
hash of seed and id (rows of one id, or without one, in the order of their components), fewer
if there are fewer vectors.

The matrix is a table in the shared folder, rewritten once per round and read where it lies:
nothing is shuffled but sums. Sums per cluster and component are combined in each task and by
an aggregation of clusters x dim rows; only they and the centroids pass the driver.

All numbers are exact. Integers up to 2^24 are computed in 64 bits; where a vector or a
centroid has a larger one, the row is computed in unbounded integers and its products are
carried as decimal text. A distance or inertia beyond 64 bits is null, the cluster is right
all the same.

Odd rows: a null id is hashed as an empty one and returned as null; rows that repeat an id are
vectors of their own; an empty table, or one without a vector that takes part, gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
SMALL = 1 << 24  # integers up to here: 64 bits hold any dot product and distance
_LIMB = 30  # sums are added up in pieces of so many bits
_LONG = 1 << 63


def vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integer-valued doubles."""
    v = rows[embedding]
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= F.lit(1.7976931348623157e308)))
    # as double before the product, and without a cast to long: no component is too large
    return rows.where((F.size(v) == dim) & finite).select(
        rows[vec_id].cast("long").alias("vec_id"), F.transform(v, lambda x: _floor(x.cast("double") * float(scale))).alias("v")
    )


def _floor(x: Column) -> Column:
    """The floor as a double; numbers of 2^52 and more have no fraction."""
    return F.when(F.abs(x) < F.lit(float(1 << 52)), F.floor(x).cast("double")).otherwise(x)


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[int(x) for x in row["v"]] for row in rows.orderBy(named, "v").limit(clusters).select("v").collect()]


@dataclass(frozen=True)
class Change:
    """What a round did to a centroid: the components that changed, and by how much."""

    cluster: int
    components: list[int]
    by: list[int]


def changes(before: list[list[int]], after: list[list[int]]) -> list[Change]:
    out = []
    for number, (old, new) in enumerate(zip(before, after, strict=True)):
        at = [i for i, (a, b) in enumerate(zip(old, new, strict=True)) if a != b]
        if at:
            out.append(Change(number, at, [new[i] - old[i] for i in at]))
    return out


def _largest(values: list[list[int]]) -> int:
    return max((abs(x) for v in values for x in v), default=0)


def _exact(values: np.ndarray) -> np.ndarray:
    """Integer-valued doubles as unbounded integers."""
    return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


class _Batch:
    """Vectors of one batch: rows in 64 bits and rows in unbounded integers, each with its products."""

    def __init__(self, values: np.ndarray, small_centroids: bool):
        self.values = values
        small = (np.abs(values) <= SMALL).all(axis=1) & small_centroids
        self.parts = [(np.flatnonzero(small), values[small].astype(np.int64)), (np.flatnonzero(~small), _exact(values[~small]))]
        self.dots: list[np.ndarray] = []

    def start(self, centroids: list[list[int]]) -> None:
        kinds = (np.int64, object)
        self.dots = [v @ np.array(centroids, kind).T if len(v) else np.zeros((0, len(centroids)), kind) for (_, v), kind in zip(self.parts, kinds, strict=True)]

    def carry(self, dots: pa.Array, wide: pa.Array, clusters: int) -> None:
        """Products of the round before; those of a row may have been carried in either form."""
        if not dots.null_count and not len(self.parts[1][0]):
            self.dots = [_matrix(dots, clusters).copy(), np.zeros((0, clusters), object)]
            return
        each = [s if s is not None else [int(x) for x in w] for s, w in zip(dots.to_pylist(), wide.to_pylist(), strict=True)]
        kinds = (np.int64, object)
        self.dots = [np.array([each[i] for i in at.tolist()], k).reshape(len(at), clusters) for (at, _), k in zip(self.parts, kinds, strict=True)]

    def update(self, changed: list[Change]) -> None:
        for change in changed:
            for (_, v), dots in zip(self.parts, self.dots, strict=True):
                if len(v):
                    dots[:, change.cluster] += v[:, change.components] @ np.array(change.by, v.dtype)

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, pa.Array]:
        """(cluster, squared distance) of every row."""
        n = len(self.values)
        cluster, distance = np.zeros(n, np.int32), np.zeros(n, object if len(self.parts[1][0]) else np.int64)
        squares = [sum(x * x for x in c) for c in centroids]
        for (at, v), dots in zip(self.parts, self.dots, strict=True):
            if len(at):
                apart = np.array(squares, v.dtype)[None, :] - 2 * dots
                best = apart.argmin(axis=1)
                cluster[at] = best
                distance[at] = apart[np.arange(len(at)), best] + (v * v).sum(axis=1)
        if distance.dtype == object:
            return cluster, pa.array([int(d) if d < _LONG else None for d in distance.tolist()], pa.int64())
        return cluster, pa.array(distance)

    def stored(self) -> tuple[pa.Array, pa.Array]:
        n, (small, wide) = len(self.values), self.dots
        if len(small) == n:
            at = pa.array(np.arange(n + 1, dtype=np.int32) * small.shape[1])
            return pa.ListArray.from_arrays(at, pa.array(small.ravel())), pa.nulls(n, pa.list_(pa.string()))
        short: list = [None] * n
        long: list = [None] * n
        for i, row in zip(self.parts[0][0].tolist(), small.tolist(), strict=True):
            short[i] = row
        for i, row in zip(self.parts[1][0].tolist(), wide.tolist(), strict=True):
            long[i] = [str(x) for x in row]
        return pa.array(short, pa.list_(pa.int64())), pa.array(long, pa.list_(pa.string()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


_STATE = "vec_id long, v array<double>, dots array<long>, wide array<string>, cluster int, distance long"


def assign(rows: DataFrame, centroids: list[list[int]], changed: list[Change] | None) -> DataFrame:
    """The matrix after a round: ``changed`` is what was done to the centroids since ``rows`` were
    assigned, or None if they never were."""
    small, dim = _largest(centroids) <= SMALL, len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _Batch(_matrix(batch.column("v"), dim), small)
            if changed is None:
                own.start(centroids)
            else:
                own.carry(batch.column("dots"), batch.column("wide"), len(centroids))
                own.update(changed)
            cluster, distance = own.nearest(centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), *own.stored(), pa.array(cluster), distance],
                ["vec_id", "v", "dots", "wide", "cluster", "distance"],
            )

    return rows.mapInArrow(run, _STATE)


def replaced(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids as floor(sum / count) of their vectors; those without any stay."""
    dim = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, cluster = _matrix(batch.column("v"), dim), batch.column("cluster").to_numpy()
            out = []
            for number in np.unique(cluster).tolist():
                mine = values[cluster == number]
                sums = mine.astype(np.int64).sum(axis=0).tolist() if (np.abs(mine) <= SMALL).all() else _exact(mine).sum(axis=0).tolist()
                for component, total in enumerate(sums):
                    sign, rest, limb = (1 if total >= 0 else -1), abs(total), 0
                    while rest or not limb:
                        out.append((number, component, limb, sign * (rest & ((1 << _LIMB) - 1)), len(mine)))
                        rest >>= _LIMB
                        limb += 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["cluster", "component", "limb", "total", "n"]
            )

    parts = rows.select("v", "cluster").mapInArrow(run, "cluster int, component int, limb int, total long, n long")
    sums = parts.groupBy("cluster", "component", "limb").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    totals: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for r in sums:
        key = r["cluster"], r["component"]
        totals[key] = totals.get(key, 0) + (r["total"] << (_LIMB * r["limb"]))
        if not r["limb"]:
            counts[r["cluster"]] = r["n"]
    return [
        [totals[number, i] // counts[number] for i in range(dim)] if number in counts else own for number, own in enumerate(centroids)
    ]


def cluster(
    rows: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: int = SCALE,
    seed: int = SEED,
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, dots, wide, cluster, distance) of every vector that takes part, and the centroids."""
    store = common.scratch(rows, "centroids")
    taken = store.save(vectors(rows, vec_id, embedding, dim, scale), "vectors")
    centroids = first_centroids(taken, clusters, seed)
    if not centroids:
        return assign(taken, [[0] * dim], None), []
    state = store.save(assign(taken, centroids, None), "matrix")
    for _ in range(rounds):
        after = replaced(state, centroids)
        state = store.save(assign(state, after, changes(centroids, after)), "matrix")
        centroids = after
    return state, centroids


def report(rows: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    state, centroids = cluster(rows, **options)
    hashed = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    known = F.count(F.when(F.col("distance").isNull(), 1)) == 0
    per = state.groupBy("cluster").agg(F.when(known, total).alias("exact")).collect() if centroids else []
    sums = {r["cluster"]: None if r["exact"] is None else int(r["exact"]) for r in per}

    def fits(n: int | None) -> int | None:
        return n if n is not None and n < _LONG else None

    every = None if None in sums.values() else fits(sum(sums.values()))
    known_of = [(n, fits(sums.get(n)), h) for n, h in enumerate(hashed)]
    names = rows.sparkSession.createDataFrame(known_of, "cluster int, cluster_inertia long, centroid_sha256 string")
    return (
        state.select("vec_id", "cluster", "distance")
        .join(F.broadcast(names), "cluster")  # one row per cluster
        .select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(every).cast("long").alias("inertia"), "centroid_sha256")
    )
