import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(ident, text, rate=50, share=80):
    """(n, form, prefix_chars, middle_chars, output) on code points."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < share:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts(seed, n):
    rng = random.Random(seed)
    parts = [" ", "\n", "\t\x0b", "é", "wörd", "日本", " ", "😀", "<", "P>", "<S", "a", "b.", "\x00", " "]
    return [(i, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(n)]


def run(documents, rows, **options):
    docs = documents(rows).withColumnsRenamed({"lang": "form", "source": "output"}).withColumn("pieces", F.lit(1))
    return fim.restore(fim.transform(docs, **options)).collect()


@pytest.mark.parametrize("options", [{}, {"rate": 100, "spm_share": 50}, {"rate": 0}])
def test_equals_brute_force_and_comes_back(documents, options):
    rows = texts(1, 150)
    rows += [(900, None), (901, ""), (None, "no id at all"), (902, " \n\t "), (903, "one"), (904, "has <M> inside " * 3), (905, "word " * 30000)]
    rows += [(906, "twice the same"), (906, "twice the same"), (906, "another text"), (907, "x" * 300000)]
    got = run(documents, rows, **options)
    want = [(i, *brute(i, t, options.get("rate", 50), options.get("spm_share", 80)), t or "") for i, t in rows]
    own = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) for r in got]
    assert sorted(own, key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        buffers = (r.text.encode(), b"<P><S><M>")
        assert b"".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces) == r.output.encode()
    if options.get("rate", 50):
        assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_cuts_split_descriptors_and_copy_nothing():
    text = b"prefix middle suffix"
    table = fim.PieceTable(text).cut(6, 13)
    assert [(p.start, p.length) for p in table.pieces] == [(0, 6), (6, 7), (13, 7)]
    assert table.cut(0, 13, 20).read() == text and len(table.cut(0, 13, 20).pieces) == 6
    for form, order in fim.ARRANGEMENTS.items():
        arranged = table.arrange(order)
        assert arranged.buffers is table.buffers
        assert arranged.restore(order).read() == text
        assert fim.parsed(arranged.read(), form).restore(order).read() == text
        assert arranged.digest() == hashlib.sha256(arranged.read()).hexdigest()


def test_empty_table(documents):
    assert run(documents, []) == []


def test_restore_keeps_other_columns(spark):
    rows = spark.createDataFrame([("<P>a<S> c<M> b", "psm", "old", 1), (None, None, None, 2)], "output string, form string, text string, `odd name` int")
    got = {r["odd name"]: r.text for r in fim.restore(rows).collect()}
    assert got == {1: "a b c", 2: ""}
