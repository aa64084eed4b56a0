import math
import random
import zlib

import numpy as np
import pytest

from gleanery.llm import toxicity

CLEAN = "the and of thon ering reed with that onea ha from tion heat".split()
BAD = ("grubble", "snirk")


def corpus(n=400, seed=3):
    """(doc_id, text, toxic): ordinary words; toxic texts hold two bad words with a free ending."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(["tio", "he", "re", "an", "sh"], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        words += rng.choices(CLEAN, k=10)
        toxic = i % 5 == 0
        if toxic:
            words += [rng.choice(BAD) + rng.choice(["", "er", "ing", "o"]) for _ in range(2)]
        rng.shuffle(words)
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


def counts(rows, order):
    """Kneser-Ney counts by the definition; every row is in the pool, and in its class if it has one."""
    occurs, before = {}, {}
    for _, text, toxic in rows:
        for word in toxicity.words_of(text):
            marked = f"^{word}$"
            for end in range(1, len(marked)):
                for begin in range(max(0, end - order + 1), end + 1):
                    for kind in {2} if toxic is None else {2, toxic}:
                        occurs.setdefault(marked[begin : end + 1], [0, 0, 0])[kind] += 1
                        before.setdefault(marked[begin : end + 1], [set(), set(), set()])[kind].add(marked[begin - 1] if begin else None)
    table = {g: n if len(g) == order or g[0] == "^" else [len(chars) for chars in before[g]] for g, n in occurs.items()}
    out = []
    for gram, each in table.items():
        same = [n[2] for g, n in table.items() if g[:-1] == gram[:-1]]
        out.append((gram, *each, sum(same), len(same)))
    return out


def in_a_class(rows):
    return [r for r in rows if r[1] + r[2]]


def test_ratios_equal_the_two_models_worked_out_plainly():
    rows = corpus(40)
    rows += [(-i, text + " zzyx", None) for i, text, _ in corpus(10, seed=4)]  # texts without a label
    order = 3
    table = {g: tuple(n) for g, *n, _, _ in counts(rows, order)}
    d, k = toxicity.DISCOUNT, toxicity.SHARED

    def after(context, y):
        return [n[y] for g, n in table.items() if g[:-1] == context and n[y]]

    def plain(gram, y, pool=None):
        """Probability of the last character after the others in one class, or pooled (no pseudo-counts)."""
        follow, extra = after(gram[:-1], y), k if pool else 0
        if pool and not (table.get(gram, (0, 0, 0))[0] or table.get(gram, (0, 0, 0))[1]):
            if not (after(gram[:-1], 0) or after(gram[:-1], 1)):
                return plain(gram[1:], y, pool)  # a context that no class has
            return (d * len(follow) + extra) / (sum(follow) + extra) * plain(gram[1:], y, pool)
        n = table[gram][y]
        if len(gram) == 1:
            mass = n
        else:
            mass = max(n - d, 0) + d * len(follow) * plain(gram[1:], y, pool)
        return (mass + (extra * plain(gram, 2) if pool else 0)) / (sum(follow) + extra)

    model = toxicity.ratios(in_a_class(counts(rows, order)), order)
    for word in ("the", "grubbleish", "snirk", "tiohean", "reo"):
        marked = f"^{word}$"
        ends = [marked[max(0, e - order + 1) : e + 1] for e in range(1, len(marked))]
        want = sum(math.log(plain(g, 1, True) / plain(g, 0, True)) for g in ends)
        assert model.word(word) == pytest.approx(want)


@pytest.mark.parametrize("order", [2, 3, 5])
def test_sequences_equal_the_definition(spark, order):
    rows = [*corpus(30), (1, "", 0), (2, "7 _", 1), (3, "é ÄB ψ grubble", None)]
    kinds = [(t, y) for _, t, y in rows if y is not None] + [(t, 2) for _, t, _ in rows]
    got = toxicity.sequences(spark.createDataFrame(kinds, "text string, kind int"), order)
    assert sorted(map(tuple, got.collect())) == sorted(counts(rows, order))


def test_lower_orders_count_contexts_not_occurrences(spark):
    often = " ".join(["qu"] * 100)
    kinds = [(often + " au eu iu", 0), ("qu", 1), (often + " au eu iu qu", 2)]
    got = {r.gram: tuple(r)[1:4] for r in toxicity.sequences(spark.createDataFrame(kinds, "text string, kind int"), 3).collect()}
    assert got["qu$"] == (100, 1, 101) and got["^q"] == (100, 1, 101)
    assert got["q"] == (1, 1, 1) and got["u"] == (4, 1, 4) and got["u$"] == (4, 1, 4)


def test_unknown_characters_are_no_evidence():
    model = toxicity.ratios(in_a_class(counts(corpus(60), 5)), 5)
    assert model.evidence(None) == model.evidence("") == model.evidence("12 !? _") == (0.0, 0.0)
    assert abs(model.word("ψψψ")) < 2


def test_remembered_words_are_bounded_in_characters(monkeypatch):
    model = toxicity.ratios(in_a_class(counts(corpus(20), 3)), 3)
    plain = toxicity.ratios(in_a_class(counts(corpus(20), 3)), 3)
    monkeypatch.setattr(toxicity, "REMEMBERED", 4000)
    for i in range(300):
        word = "ab" * (i * 7 % 1500 + 1)
        assert model.word(word) == plain._ratio(word)
        assert sum(map(len, model.known)) <= 2000 and sum(map(len, model.older)) <= 2000


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y, "l") for i, _, y in rows], "doc_id long, toxic int, text string")
    return docs, labels


def test_held_out_texts(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert len(held) > 50
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    flipped = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, t, y in rows]
    _, other = tables(spark, flipped)
    a, b = (sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, x)).collect())) for x in (labels, other))
    assert a == b


def test_odd_rows(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    model = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, "l"), (1, None, "l"), (2, 0, "l")], labels.schema)))
    odd = spark.createDataFrame(
        [(None, "grubble snirk", "a"), (1, None, "b"), (2, "", "c"), (3, "the " * 40_000 + "snirk grubbleo", "d"), (3, "the", "e"), (3, "the", "e")],
        "doc_id long, text string, score string",
    )
    got = toxicity.score(odd, model).collect()
    assert len(got) == 6
    by = {(r.doc_id, r.predicted) for r in got}
    assert (None, 1) in by and (1, 0) in by and (2, 0) in by and (3, 1) in by and (3, 0) in by
    kept = toxicity.keep_ordinary(odd, model)
    assert kept.columns == odd.columns and sorted(r.score for r in kept.collect()) == ["b", "c", "e", "e"]
    assert toxicity.score(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("only", [None, 0, 1])
def test_missing_labels(spark, only):
    docs, labels = tables(spark, corpus(40))
    labels = labels.where("false") if only is None else labels.where(f"toxic = {only}")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 40 and all(0 <= r.score <= 1 for r in got)


def test_the_sample_is_bounded(spark):
    docs, labels = tables(spark, corpus())
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "toxic")
    assert toxicity._sample(docs, labels, 50, 5).count() == 50
    assert toxicity._sample(docs.unionByName(docs), labels, 50, 5).count() == 50
