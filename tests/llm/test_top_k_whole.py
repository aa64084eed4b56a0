"""Every finite vector and every row takes part: the rules of the SQL of op4_top_k, without its 64-bit limit."""

import math
import random

import numpy as np
import pytest
from pyspark import Broadcast, SparkContext

from gleanery.llm import top_k
from tests.llm.test_top_k import clustered, frame

LONG = range(-(1 << 63), 1 << 63)


def brute(rows, k=5, every=50):
    taking = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows]
    best = {}
    for q, v in taking:
        if q % every == 0:
            best.setdefault(q, []).extend((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in taking if i != q)
    return sorted((q, r + 1, i, -s if -s in LONG else None) for q, found in best.items() for r, (s, i) in enumerate(sorted(found)[:k]))


def result(spark, rows, **options):
    got = top_k.top_k(frame(spark, rows), **options).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "sample": 10, "block": 4, "ring": 7}])
def test_large_components(spark, options):
    rows = clustered(200, 8, 1)
    rows += [(1000, [70000.0] + [0.0] * 7), (1001, [-70000.0, 1.0] * 4), (1002, [1e12] * 8), (1003, [-3e38] * 8), (1050, [3e38] * 8), (1004, [2e7, 0.5] * 4)]
    # scores that differ in their last digits only, beyond what a float holds
    rows += [(1100 + i, [2.0**30, 2.0**30, i / 256] + [0.0] * 4 + [1.0]) for i in range(20)]
    assert result(spark, rows, **options) == brute(rows)


def test_only_large_components(spark):
    rows = [(50 * i, [70000.0 + i, -1e9 * i]) for i in range(12)]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "sample": 10, "block": 4, "ring": 7}])
def test_repeated_ids(spark, options):
    rng = random.Random(5)
    rows = clustered(120, 4, 2)
    rows += [(50, [rng.gauss(0, 1) for _ in range(4)]) for _ in range(6)]
    rows += [(7, [9.0] * 4)] * 9 + [(8, [9.0] * 4), (8, [-9.0] * 4)] + [(100, rows[100][1])] * 8 + [(9, [1e6] * 4)] * 2
    assert result(spark, rows, **options) == brute(rows)


def test_sortable():
    rng = random.Random(1)
    some = sorted({0, 1, -1, *(rng.choice((1, -1)) * rng.getrandbits(rng.randint(1, 900)) for _ in range(300))})
    assert sorted(some, key=top_k.sortable) == some


def test_blocks_run_one_at_a_time(spark, monkeypatch):
    """Only one block is broadcast at a time, and none is left when the result is there."""
    live, most = set(), []
    plain, destroy = SparkContext.broadcast, Broadcast.destroy

    def broadcast(self, value):
        out = plain(self, value)
        live.add(id(out))
        most.append(len(live))
        return out

    def destroyed(self, *args):
        live.discard(id(self))
        destroy(self, *args)

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroyed)
    rows = [*clustered(40, 4, 6), (50, [1e6] * 4)]
    got = top_k.top_k(frame(spark, rows), queries=top_k.F.col("vec_id") < 60, block=20)
    assert len(most) > 4 and max(most) == 1 and not live
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(rows, every=1)
