import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import top_k

COLUMNS = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, k=5, every=50):
    """Every row with an id and finite components takes part, against all rows of other ids."""
    taking = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    best = {}
    for q, v in taking:
        if q % every == 0:
            best.setdefault(q, []).extend((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in taking if i != q)
    long = range(-(1 << 63), 1 << 63)
    return sorted(
        ((q, r + 1, i, -s if -s in long else None) for q, found in best.items() for r, (s, i) in enumerate(sorted(found)[:k])), key=repr
    )


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], COLUMNS)


def clustered(n, dim, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "sample": 10, "block": 4, "ring": 7}])
def test_equals_brute_force(spark, options):
    rng = random.Random(2)
    rows = clustered(600, 8, 1)
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # a third of all rows is one vector
    rows += [(2000, None), (2050, [0.1, None] * 4), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    rows += [(2200, []), (2250, [1.0, 2.0]), (2300, [0.0] * 8), (2350, [1e30] * 8), (2400, [60000.0] * 8), (2401, [-60000.0] * 8)]
    rows += [(50, [rng.gauss(0, 1) for _ in range(8)]), (50, rows[50][1]), (-50, [0.3] * 8)]
    got = top_k.top_k(frame(spark, rows), **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [2.0, 1.0]), (7, [0.0, 0.0])]
    assert sorted(map(tuple, top_k.top_k(frame(spark, rows)).collect()), key=repr) == brute(rows)
    assert top_k.top_k(frame(spark, rows[:1])).count() == 0
    assert top_k.top_k(frame(spark, rows).limit(0)).count() == 0
    assert top_k.top_k(frame(spark, [(0, None)])).count() == 0


def test_other_queries(spark):
    rows = clustered(80, 4, 3)
    got = top_k.top_k(frame(spark, rows), queries=F.col("vec_id") < 3, k=2)
    want = [r for r in brute(rows, 2, 1) if r[0] < 3]
    assert sorted(map(tuple, got.collect())) == want


def test_annuli_are_skipped(monkeypatch):
    """With near clusters most annuli stay closed, and the result is still exact."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 400, (20, 16))
    v = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 10, (4000, 16))).astype(np.int64)
    longest = float((v**2).sum(axis=1).max())
    points = top_k.lifted(v, longest)
    pivots = top_k.farthest_first(points[:500], 32)
    far = top_k.distances(points, pivots)
    pivot = far.argmin(axis=1)
    far = far[np.arange(len(v)), pivot]
    order = np.lexsort((far, pivot))
    ids = np.arange(len(v))

    class Row:
        def __init__(self, i):
            self.vec_id, self.v = int(i), v[i].tolist()

    block = top_k._block([Row(i) for i in range(0, 4000, 200)], v[:500], ids[:500], pivots, 16, longest, 5)
    seen = []
    plain = top_k.scores
    monkeypatch.setattr(top_k, "scores", lambda q, w: (seen.append(len(q) * len(w)), plain(q, w))[1])
    best = top_k.Best(block["floor"], 5)
    top_k.search(block, ids[order], v[order], pivot[order], far[order], best, 64)
    assert sum(seen) < 0.5 * 20 * 4000
    for n, q in enumerate(range(0, 4000, 200)):
        s = v @ v[q]
        want = sorted((-s[i], i) for i in range(4000) if i != q)[:5]
        mine = [(-s_, i) for a, s_, i in zip(best.query, best.score, best.id, strict=True) if a == n]
        assert mine == want
