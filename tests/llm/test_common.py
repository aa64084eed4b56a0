import pytest
from pyspark.sql import functions as F

from gleanery.llm import common


@pytest.mark.parametrize("words", [1, 1 << 10])
def test_without_equals_an_anti_join(spark, words):
    rows = [(i % 50 if i % 7 else None, f"t{i % 11}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "key_0 long, maybe string, word int")
    gone = [(3, "t1"), (None, "t0"), (49, "t5"), (1000, "x")]
    left = common.without(df, [df["key_0"], df["maybe"]], spark.createDataFrame(gone + gone, "a long, b string"), words)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted((r for r in rows if r[:2] not in gone), key=str)


def test_without_nothing(spark):
    df = spark.range(5)
    none = df.select("id").limit(0)
    assert common.without(df, [df["id"]], none).count() == 5
    assert common.without(df.limit(0), [df["id"]], df.select("id")).count() == 0


def test_members_are_always_found(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    for words in (1, 64, 4096):
        bits = common.membership_words(keys, "key", words)
        assert bits.count() <= words
        met = keys.withColumn("word", common.member_word(F.col("key"), words)).join(bits, "word")
        assert met.where(common.probable_member(F.col("key"), F.col("mask"), words)).count() == 5000


def test_slices_hold_whole_texts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (3, 0, 50, 1, 1, 9)])], ["t"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0)]), "t", 5))
    assert [p.column("t").to_pylist() for p in parts if p.num_rows] == [["aaa", "", "a" * 50], ["a", "a", "a" * 9]]
