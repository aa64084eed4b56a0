import hashlib
import re

from pyspark.sql import functions as F

from gleanery.llm import exact_dedup

LONG = "word " * 30_000
ROWS = [
    (5, "a b"), (3, "a \t\n b"), (9, "a b "), (1, None), (2, ""), (4, "x" * 64 + "1"), (6, "x" * 64 + "2"),
    (7, LONG), (8, LONG), (10, " a"), (11, "é"), (12, "é"), (None, "a b"), (None, "only"), (None, "only"),
    (20, "same"), (20, "same"),
]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        ids = [j for (j, _), u in zip(rows, norm, strict=True) if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_report_equals_brute_force(documents):
    got = exact_dedup.report(documents(ROWS)).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_a_full_bit_set_changes_nothing(documents):
    docs = documents(ROWS)
    keyed = exact_dedup.refine(docs, words=1).withColumn("own", F.col("row.doc_id"))
    found = exact_dedup.decide(keyed, exact_dedup.groups(keyed, "own"), "own")
    got = [tuple(r) for r in found.select("own", "keep_id", "group_size", "kept", F.sha2("body", 256)).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_dedup_keeps_columns_with_any_names(documents):
    names = ("size", "head", "full", "keep_id", "kept", "word", "mask", "row", "body", "group_size", "own")
    docs = documents([(1, "a"), (2, "a"), (3, "b")]).withColumns({n: F.lit(n) for n in names})
    left = exact_dedup.dedup(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_single_texts_are_not_hashed_in_full(documents):
    keyed = exact_dedup.refine(documents([(1, "a"), (2, "bb"), (3, "ccc")]))
    assert keyed.where("full is not null").count() == 0


def test_empty_table(documents):
    assert exact_dedup.report(documents([])).count() == 0
    assert exact_dedup.dedup(documents([])).count() == 0
