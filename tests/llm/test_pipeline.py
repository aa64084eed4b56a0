import re
from pathlib import Path

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gleanery.llm import packing, toxicity
from gleanery.llm.queries import vocabulary
from tests.llm.test_simhash import brute_print, brute_roots

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no benchmark tables here")


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, stage(spark, docs, SF).cache()
        out.append((name, given, docs))
    return {name: (a, b) for name, a, b in out}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_columns(stages, spark):
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "packing"]
    for name in list(stages)[:-1]:
        given, kept = stages[name]
        assert kept.schema == given.schema
        assert kept.exceptAll(given).count() == 0 and 0 < kept.count() < given.count()


def test_toxicity(stages, spark):
    given, kept = stages["toxicity"]
    model = toxicity.fit(given, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(given, model).where("predicted = 1").collect()}
    assert toxic and ids(kept) == [i for i in ids(given) if i not in toxic]


def test_exact_dedup(stages):
    given, kept = stages["exact_dedup"]
    first = {}
    for r in given.collect():
        text = re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")
        first[text] = min(r.doc_id, first.get(text, r.doc_id))
    assert ids(kept) == sorted(first.values())


def test_near_dedup(stages):
    given, kept = stages["near_dedup"]
    marks = {r.doc_id: brute_print(r.text) for r in given.collect()}
    root, first = brute_roots(set(marks.values())), {}
    for i, m in marks.items():
        first[root[m]] = min(i, first.get(root[m], i))
    assert ids(kept) == sorted(first.values())


def test_packing_and_run(stages, spark):
    given, packed = stages["packing"]
    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = {r.doc_id: len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in given.collect()}
    got = {}
    for r in packed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id] and r.length <= packing.MOST
    assert got == want
    run = corpus_pipeline.run(spark, SF).drop("sequence_id")
    assert run.exceptAll(packed.drop("sequence_id")).count() == 0 and run.count() == packed.count()


def test_stages_with_workers_get_small_batches(stages, spark):
    given = stages["toxicity"][0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        if name != "exact_dedup":  # built-in expressions only
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
            stage(spark, given, SF)
            assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20, name


def test_odd_rows(documents, spark):
    rows = [(1, "a b c d e"), (2, "a b  c d\ne"), (3, None), (4, ""), (None, "a b c d e"), (None, "f"), (5, "zz yy xx ww vv uu"), (5, "zz yy xx ww vv uu")]
    docs = documents(rows).withColumnRenamed("lang", "component_id").withColumnRenamed("source", "fp")
    left = corpus_pipeline.distinct_texts(spark, docs, SF)
    assert left.columns == docs.columns
    near = corpus_pipeline.distinct_prints(spark, left, SF)
    assert near.columns == docs.columns
    assert {r.doc_id for r in near.collect()} >= {1, 3, 5}
    assert 2 not in ids(near.where("doc_id is not null")) and 4 not in ids(near.where("doc_id is not null"))
    empty = documents([])
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, SF).count() == 0, name


def test_one_document_of_each_group_stays(documents, spark):
    """An id with two texts, linked or not: what goes is a text of an id, and every group keeps one."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(400)) for x in "abc")
    # 5 leads b's group, but its other text goes to 1; 7 has both near-equal texts of c
    rows = [(1, a), (5, a + " x"), (5, b), (6, b + " y"), (7, c), (7, c + " z"), (9, c + " w")]
    marks = [brute_print(t) for _, t in rows]
    root = brute_roots(set(marks))
    assert [root[m] for m in marks] == [root[marks[i]] for i in (0, 0, 2, 2, 4, 4, 4)] and len(set(root.values())) == 3
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.distinct_prints(spark, documents(rows), SF).collect()}
    assert {(1, a), (5, b)} < kept and len(kept) == 3 and kept - {(1, a), (5, b)} < {(7, c), (7, c + " z")}
