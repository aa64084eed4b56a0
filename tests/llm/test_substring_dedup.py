import random
import re
from collections import Counter

import numpy as np
import pytest

from gleanery.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    split = [WORD.findall(t or "") for _, t in rows]
    runs = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (ident, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if runs[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((ident, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def texts(seed, docs, words, vocabulary=400):
    rng = random.Random(seed)
    known = [f"w{i}" for i in range(vocabulary)] + ["é", "日本", " ", "a" * 90]
    shared = [rng.choices(known, k=rng.randint(5, 60)) for _ in range(8)]
    out = []
    for i in range(docs):
        body = []
        while len(body) < words:
            body += rng.choice(shared) if rng.random() < 0.3 else rng.choices(known, k=rng.randint(1, 30))
        out.append((i, "".join(w + rng.choice([" ", "\n", " \t", "\x0b\r"]) for w in body)))
    return out


def run(documents, rows, **options):
    got = sd.dedup(documents(rows).withColumnsRenamed({"lang": "n_words", "source": "content"}), **options).collect()
    for r in got:
        assert sum(x.last - x.first + 1 for x in r.removed) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr)


@pytest.mark.parametrize(("window", "runs", "most"), [(35, None, 1 << 31), (10, 4, 1 << 31), (3, 3, 1 << 31), (1, None, 1 << 31), (12, 6, 1 << 10)])
def test_equals_brute_force(documents, window, runs, most):
    rows = texts(window, 40, 150)
    want = brute(rows, window)
    assert run(documents, rows, window=window, runs=runs, most_cells=most) == want
    assert sum(n for _, _, n, _ in want)


def test_odd_rows(documents):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n "), (None, passage), (None, None), (4, f"before {passage} after"), (5, "short text"), (5, "short text")]
    rows += [(6, "again " * 36), (7, "again " * 34), (8, " ".join(f"q{i}" for i in range(40))), (8, " ".join(f"q{i}" for i in range(40)))]
    rows += [(9, "x" * 200_000 + " tail"), (10, " ".join(str(i) for i in range(30_000))), (8, " ".join(f"r{i}" for i in range(40)))]
    assert run(documents, rows) == brute(rows, 35)


def test_hot_passage(documents):
    passage = " ".join(f"hot{i}" for i in range(50))
    rows = [(i, f"{i} own {passage if i % 3 == 0 else i} end {i}") for i in range(900)]
    assert run(documents, rows) == brute(rows, 35)


def test_blocks_of_one_long_text(documents, monkeypatch):
    monkeypatch.setattr(sd, "WORDS_AT_ONCE", 50)
    text = texts(5, 1, 900)[0][1]
    words = sd.Words.of([b"", text.encode(), b"  ", text.encode()[:700]])
    blocks = list(words.blocks(20))
    assert len(blocks) > 10
    starts = [i for b in blocks for i in (b.first + np.flatnonzero(b.whole)).tolist()]
    n = words.bounds
    assert starts == [*range(0, n[2] - 19), *range(n[3], n[4] - 19)]
    for b in blocks:
        hashes, least = b.anchors(20, 8)
        assert (least == [hashes[i : i + 8].min() for i in range(len(least))]).all()


def test_filled_sketch_loses_nothing(documents, monkeypatch):
    """A sketch of far too few cells estimates every window repeated; the exact grouping puts it right."""
    monkeypatch.setattr(sd, "BLOCK_CELLS", 16)
    monkeypatch.setattr(sd, "SHIPPED", 100)
    rows = texts(8, 30, 200)
    assert run(documents, rows, window=15, most_cells=64) == brute(rows, 15)


def test_counts_are_never_too_small(documents, monkeypatch):
    monkeypatch.setattr(sd, "SHIPPED", 500)
    rows = texts(9, 60, 120)
    frame = sd._texts(documents(rows).repartition(5), "doc_id", "text")
    sketch = sd.build_sketch(frame, 12, 5, sd.size_of(frame))
    words = sd.Words.of([t.encode() for _, t in rows])
    seen: dict[bytes, list[bool]] = {}
    for b, found in sd._estimated(words, sketch, 12, 5):
        for i in np.flatnonzero(b.whole).tolist():
            seen.setdefault(b.body[b.starts[i] : b.ends[i + 11]], []).append(i in set(found.tolist()))
    assert all(all(flags) for flags in seen.values() if len(flags) > 1)
    once = [flags[0] for flags in seen.values() if len(flags) == 1]
    assert sum(once) < 0.5 * len(once)


def test_empty_table(documents):
    assert run(documents, []) == []
