"""Leader clustering against the one-by-one loop it has to equal."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gleanery.operators import leaders as L
from gleanery.operators.similarity import profile, similar_pairs
from gleanery.session import Scratch


def greedy(keys, threshold):
    """(key number) -> leader number, comparing each key to the leaders so far."""
    found, lead = [], {}
    for i, key in enumerate(keys):
        for j in found:
            if SequenceMatcher(None, key, keys[j]).ratio() >= threshold:
                lead[i] = j
                break
        else:
            found.append(i)
            lead[i] = i
    return lead


def spoilt(word, rng, edits):
    chars = list(word)
    for _ in range(edits):
        at = rng.randrange(len(chars) + 1)
        how = rng.random()
        if how < 0.4 and chars:
            chars[at % len(chars)] = rng.choice("abcdefgh ")
        elif how < 0.7:
            chars.insert(at, rng.choice("abcdefgh "))
        elif len(chars) > 1:
            chars.pop(at % len(chars))
    return "".join(chars)


def near_copies(seed, bases, copies, size=(4, 45)):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(*size))) for _ in range(bases)]
    out = list(words)
    for _ in range(copies):
        word = rng.choice(words) if rng.random() < 0.5 else words[0]
        out.append(spoilt(word, rng, rng.randint(1, 6)))
    rng.shuffle(out)
    return list(dict.fromkeys(out))


def frame(spark, keys):
    return spark.createDataFrame(list(enumerate(keys)), "kid long, key string")


@pytest.mark.parametrize("threshold", [0.85, 0.92])
def test_pairs_equal_all_pairs(spark, threshold):
    keys = [k for k in near_copies(3, 25, 160)] + ["", "a", "b", "ab", "abc", "abcd", "abce", "é" * 9, "é" * 10]
    keys = list(dict.fromkeys(keys))
    expected = {
        (i, j)
        for j in range(len(keys))
        for i in range(j)
        if SequenceMatcher(None, keys[j], keys[i]).ratio() >= threshold
    }
    scratch = Scratch(spark, "test")
    table = scratch.save(profile(frame(spark, keys), threshold), "p").withColumn("is_target", F.lit(True))
    pairs = [(r.lo, r.hi) for r in similar_pairs(table, table.drop("is_target"), threshold).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == expected
    assert len(expected) > 100


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("few", [0, 1000])
def test_leaders_equal_the_loop(spark, monkeypatch, seed, few):
    monkeypatch.setattr(L, "FEW", few)
    monkeypatch.setattr(L, "DENSE", few and L.DENSE)  # 0: only thinning rounds until they stall
    keys = near_copies(seed, 12, 150)
    expected = greedy(keys, 0.85)
    got = {r.kid: r.leader for r in L.assign_leaders(frame(spark, keys), Scratch(spark, "test")).collect()}
    assert got == expected
    assert len(set(expected.values())) < len(keys)


def test_hot_bigrams_are_split(spark, monkeypatch):
    import gleanery.operators.similarity as S

    monkeypatch.setattr(S, "SALT_ROWS", 7)
    keys = near_copies(5, 10, 80)
    table = Scratch(spark, "test").save(profile(frame(spark, keys)), "p")
    assert table.where(F.exists("salts", lambda s: s > 1)).count() > 0
    got = {r.kid: r.leader for r in L.assign_leaders(frame(spark, keys), Scratch(spark, "test")).collect()}
    assert got == greedy(keys, 0.85)


def test_low_threshold_is_refused(spark):
    with pytest.raises(ValueError):
        profile(frame(spark, ["ab"]), 0.7)


def test_pairs_are_spread_before_they_are_verified(spark):
    table = Scratch(spark, "test").save(profile(frame(spark, ["abcdefgh", "abcdefgi", "zzz"])), "p").withColumn("is_target", F.lit(True))
    plan = similar_pairs(table, table.drop("is_target"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM")


def rows_written(spark, keys, monkeypatch):
    """How many rows the clustering writes, all its intermediate tables together."""
    written, save = [], Scratch.save

    def counted(self, df, label):
        out = save(self, df, label)
        written.append(out.count())
        return out

    with monkeypatch.context() as m:
        m.setattr(Scratch, "save", counted)
        found = {r.kid: r.leader for r in L.assign_leaders(frame(spark, keys), Scratch(spark, "test")).collect()}
    return found, sum(written)


def test_near_copies_are_not_compared_with_each_other(spark, monkeypatch):
    keys = [f"customer#{i:09d} nation {i % 3}" for i in range(0, 30_000, 10)]
    found, written = rows_written(spark, keys, monkeypatch)
    assert found == greedy(keys, 0.85)
    assert written < 6 * len(keys)


@pytest.mark.parametrize("size", [(4, 45), (60, 150)])
def test_nearest_equals_all_pairs(spark, monkeypatch, size):
    import gleanery.operators.similarity as S

    monkeypatch.setattr(S, "SALT_ROWS", 40)
    keys = near_copies(7, 10, 150, size) + ["", "x" * 1100, "x" * 1099 + "y"]
    table = Scratch(spark, "test").save(profile(frame(spark, keys)), "p")
    got = {r.kid: r.leader for r in S.nearest(table, table.where("kid % 3 <> 1")).collect()}
    want = {}
    for i, key in enumerate(keys):
        for j in range(i):
            if j % 3 != 1 and SequenceMatcher(None, key, keys[j]).ratio() >= 0.85:
                want[i] = j
                break
    assert got == want and len(want) > 20


def test_common_subsequences():
    import gleanery.operators.similarity as S

    rng = random.Random(4)
    for n in (1, 63, 64, 65, 128, 130):
        key = "".join(rng.choice("abcd") for _ in range(n))
        others = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 150))) for _ in range(20)]
        want = []
        for other in others:
            row = [0] * (len(other) + 1)
            for x in key:
                last = row[:]
                for j, y in enumerate(other):
                    row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
            want.append(row[-1])
        masks = {c: sum(1 << i for i, k in enumerate(key) if k == c) for c in key}
        assert [S._subsequence(masks, n, o) for o in others] == want
        assert S._subsequences(S._codes([key], n)[0], S._codes(others, 150).T).tolist() == want


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("size", [(4, 45), (60, 150)])
def test_parts_of_a_block_equal_the_loop(spark, monkeypatch, seed, size):
    """Every part goes through the loop alone; keys whose leader is covered by an earlier part are settled anew."""
    monkeypatch.setattr(L, "LEAST", 8)
    monkeypatch.setattr(L, "FEW", 60 if seed < 3 else 1000)
    keys = near_copies(seed, 14, 160, size)
    again = []
    with monkeypatch.context() as m:
        settled = L.settled
        m.setattr(L, "settled", lambda pairs: again.append(1) or settled(pairs))
        got = {r.kid: r.leader for r in L.assign_leaders(frame(spark, keys), Scratch(spark, "test")).collect()}
    assert got == greedy(keys, 0.85)
    assert again


def test_no_task_goes_through_a_large_block(spark, monkeypatch):
    import gleanery.operators.similarity as S

    rng = random.Random(9)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(2400)]
    cells, parts = [], L.one_by_one
    monkeypatch.setattr(L, "FEW", 2400)
    monkeypatch.setattr(L, "LEAST", 200)

    def counted(block, threshold, part=None, count=1):
        cells.extend(r["count"] for r in block.groupBy(F.lit(0) if part is None else part).count().collect())
        return parts(block, threshold, part, count)

    monkeypatch.setattr(L, "one_by_one", counted)
    got = {r.kid: r.leader for r in L.assign_leaders(frame(spark, keys), Scratch(spark, "test")).collect()}
    assert got == {i: i for i in range(len(keys))}
    assert max(cells) <= 220 and sum(cells) == len(keys)
    assert S.THRESHOLD == 0.85


@pytest.mark.parametrize("probes", [64, 1 << 16])
def test_counts_of_characters_lose_no_pair(monkeypatch, probes):
    """Characters by tables equal a count of all, up to levels that are not told apart."""
    import numpy as np
    import pyarrow as pa

    import gleanery.operators.similarity as S

    monkeypatch.setattr(S, "_PROBES", probes)
    keys = near_copies(11, 12, 200, (1, 60)) + ["", "aaaaaaaaaaaaaaaaaaaaaaaa", "é" * 300, "ab" * 900]
    columns, bits = S._choose(keys)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(keys)), pa.int64()), pa.array(keys)], ["kid", "key"])
    table = pa.Table.from_batches(list(S._signed(columns, bits)(iter([batch]))))
    side, targets = S._Side(table, "n"), S._Side(table, "kid")
    filtered = S._Filter(side, targets, 0.85)
    near = {(int(t), int(side.kid[p])) for t, p in zip(*filtered.near(np.arange(len(keys))), strict=True)}
    alike = {(int(t), int(side.kid[p])) for t, p in zip(*filtered.alike(*filtered.near(np.arange(len(keys)))), strict=True)}
    similar = {(i, j) for i, a in enumerate(keys) for j, b in enumerate(keys) if a and b and SequenceMatcher(None, b, a).ratio() >= 0.85}
    assert similar <= alike <= near
    assert len(near) < len(keys) ** 2 / 2


def test_a_key_that_loses_its_leader_is_settled_anew(spark, monkeypatch):
    rng = random.Random(5)
    keys = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(24)]
    keys[20] = "xxxxxxx" + keys[0][7:]  # like the first, whose part is another
    keys[21] = keys[20][:50] + "yyyyyyy" + keys[20][57:]  # like that one only
    keys[22] = keys[21][:30] + "z" + keys[21][31:]
    asked, settled = [], L.settled
    monkeypatch.setattr(L, "FEW", 1000)
    monkeypatch.setattr(L, "LEAST", 12)
    monkeypatch.setattr(L, "settled", lambda pairs: asked.append(1) or settled(pairs))
    got = {r.kid: r.leader for r in L.assign_leaders(frame(spark, keys), Scratch(spark, "test")).collect()}
    assert got == greedy(keys, 0.85)
    assert (got[20], got[21], got[22]) == (0, 21, 21)
    assert len(asked) > 1
