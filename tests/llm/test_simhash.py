import random
import re

import numpy as np
import pytest
import xxhash

from gleanery.llm import simhash


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(marks, most=4):
    root = {m: m for m in marks}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    marks = sorted(marks)
    for i, a in enumerate(marks):
        for b in marks[:i]:
            if (a ^ b).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {m: find(m) for m in marks}


def near(rng, mark, bits):
    for b in rng.sample(range(64), bits):
        mark ^= 1 << b
    return mark


def marks(seed, groups, each, chain):
    rng = random.Random(seed)
    out = set()
    for _ in range(groups):
        m = rng.getrandbits(64)
        for _ in range(each):
            out.add(near(rng, m, rng.randint(0, 4)))
        for _ in range(chain):
            m = near(rng, m, rng.randint(3, 5))
            out.add(m)
    return out


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b", "a b\tc  d", "a b c d e", "É é a b c \x85 \xa0x y", "w " * 70_000, "the same " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_print(text)


def by_component(pairs, nodes):
    root = {n: n for n in nodes}
    for a, b in pairs:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    out = {}
    for n in nodes:
        m = n
        while root[m] != m:
            m = root[m]
        out[n] = m
    return out


def test_index_finds_what_all_pairs_find():
    for seed in range(4):
        some = sorted(marks(seed, 30, 40, 20))
        ranked = np.array(some, np.uint64)
        rank = ranked.copy()
        for by in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(by)
        ranked = ranked[np.argsort(rank)]
        a, b = simhash.stars(ranked)
        assert by_component(zip(a.tolist(), b.tolist(), strict=True), some) == brute_roots(some)
        cut = len(ranked) // 3
        parts = [simhash.stars(ranked[:cut]), simhash.stars(ranked[cut:]), simhash.stars(ranked[:cut], ranked[cut:])]
        links = [x for a, b in parts for x in zip(a.tolist(), b.tolist(), strict=True)]
        assert by_component(links, some) == brute_roots(some)


def signed(mark):
    return mark - (1 << 64) if mark >> 63 else mark


@pytest.mark.parametrize(("chunk", "groups"), [(4096, 12), (7, 4)])
def test_distributed_components(spark, chunk, groups):
    some = marks(11, groups, 12, 8) | {0, (1 << 64) - 1, 1 << 63}
    # one hot band value: marks that agree in their low 13 bits
    some |= {(m >> 13 << 13) | 5 for m in list(some)[:60]}
    nodes = spark.createDataFrame([(signed(m),) for m in some], "fp long")
    found = simhash.components(simhash.links(nodes, chunk=chunk)).collect()
    root = {r.node: r.root for r in found}
    want = brute_roots(some)
    groups_of = {}
    for m, r in want.items():
        groups_of.setdefault(r, set()).add(signed(m))
    got = {}
    for m in some:
        got.setdefault(root.get(signed(m), signed(m)), set()).add(signed(m))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups_of.values()))


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(300)] + [(2000, 1999), (5000, 5000)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {0}
    assert {got[1000 + i] for i in range(1, 300)} == {1000}
    assert got[2000] == 1999 and 0 not in got and 5000 not in got


def test_documents(spark, documents):
    base = "one two three four five six seven eight nine ten " * 20
    rows = [(3, base), (1, base.upper()), (9, base + "x"), (2, None), (7, " "), (4, "quite another text"), (None, base), (None, "alone"), (3, base)]
    got = simhash.near_duplicates(documents(rows).withColumnsRenamed({"lang": "fp", "source": "root"})).collect()
    prints = {(i, brute_print(t)) for i, t in rows}
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in got} == prints and len(got) == len(rows)
    want = brute_roots({p for _, p in prints})
    first = {}
    for i, p in prints:
        if i is not None:
            first[want[p]] = min(i, first.get(want[p], i))
    for r in got:
        assert r.component_id == first.get(want[int(r.fingerprint, 16)])


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).count() == 0
