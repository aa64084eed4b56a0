import hashlib
import math
import random

import numpy as np
import pytest

from gleanery.llm import centroids as C

COLUMNS = "vec_id long, embedding array<float>, cluster string, v int, distance string"


def frame(spark, rows, columns=COLUMNS):
    return spark.createDataFrame([(i, v, "clash", 1, None) for i, v in rows], columns)


def brute(rows, clusters, rounds, dim, scale=64, seed=1, kind=np.float32):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(kind(x)) for x in v):
            kept.append((i, [math.floor(scale * float(kind(x))) for x in v]))
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in kept[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        centres = [
            [sum(x) // len(x) for x in zip(*m, strict=True)] if (m := [v for (_, v), o in zip(kept, own, strict=True) if o == n]) else c
            for n, c in enumerate(centres)
        ]
    found = [(i, *nearest(v)) for i, v in kept]
    fits = lambda x: x if x < 2**63 else None
    per = {n: [fits(d) for _, d, o in found if o == n] for n in range(len(centres))}
    sums = {n: None if None in ds else fits(sum(ds)) for n, ds in per.items()}
    total = None if any(fits(d) is None for _, d, _ in found) else fits(sum(d for _, d, _ in found))
    hashed = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, fits(d), sums[n], total, hashed[n]) for i, d, n in found), key=repr)


def clustered(n, dim, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(n)]


def run(spark, rows, columns=COLUMNS, **options):
    got = C.report(frame(spark, rows, columns), **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize(("clusters", "rounds"), [(16, 3), (1, 1), (5, 0), (40, 2)])
def test_equals_brute_force(spark, clusters, rounds):
    rows = clustered(300, 6, 1)
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]  # a third of all rows is one vector
    rows += [(2000, None), (2001, [0.1, None] * 3), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, []), (2005, [1.0])]
    rows += [(None, [1.0] * 6), (None, [2.0] * 6), (7, [0.25] * 6), (7, rows[7][1])]
    assert run(spark, rows, clusters=clusters, rounds=rounds, dim=6) == brute(rows, clusters, rounds, 6)


def test_empty_clusters_stay(spark):
    rows = [(i, [0.0, 0.0]) for i in range(20)] + [(50, [9.0, 9.0])]
    got = run(spark, rows, clusters=4, dim=2)
    assert got == brute(rows, 4, 3, 2)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_large_components_are_exact(spark, kind):
    number = np.float32 if kind == "float" else np.float64
    rows = clustered(40, 4, 2) + [(100, [1e30] * 4), (101, [-3e37, 1.0, 2e6, 0.5]), (102, [1e9, 0.0, 0.0, 1.0]), (103, [262144.5, 0.0, 0.0, -1.0])]
    if kind == "double":
        rows += [(104, [1.7e306, 0.0, -1e300, 3.0]), (105, [1e17 + 16, 0.0, 0.0, 0.0])]
    columns = COLUMNS.replace("array<float>", f"array<{kind}>")
    for clusters in (3, 20):
        assert run(spark, rows, columns, clusters=clusters, dim=4) == brute(rows, clusters, 3, 4, kind=number)


def test_only_changed_components_count(spark):
    before, after = [[1, 2, 3], [4, 5, 6], [7, 8, 9]], [[1, 2, 3], [4, 0, 6], [8, 8, 1]]
    changed = C.changes(before, after)
    assert changed == [C.Change(1, [1], [-5]), C.Change(2, [0, 2], [1, -8])]
    taken = C.vectors(frame(spark, clustered(50, 3, 4)), dim=3)
    updated = C.assign(C.assign(taken, before, None), after, changed)
    anew = C.assign(taken, after, None)
    assert sorted(map(tuple, updated.collect()), key=repr) == sorted(map(tuple, anew.collect()), key=repr)
    # a product with a centroid that stayed is never touched, not even a wrong one
    spoilt = C.assign(taken, before, None).selectExpr("vec_id", "v", "transform(dots, (d, i) -> if(i = 0, 77L, d)) as dots", "wide", "cluster", "distance")
    assert {r.dots[0] for r in C.assign(spoilt, after, changed).collect()} == {77}


def test_few_and_no_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert run(spark, rows, dim=2) == brute(rows, 16, 3, 2)
    assert run(spark, [(1, None)], dim=2) == []
    assert C.report(frame(spark, rows).limit(0), dim=2).count() == 0
