"""What the operators share: tables, working storage, filters of fixed size, text batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import Scratch

WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Arrow batches of about ``most`` bytes from here on: what a task holds of long texts or payloads."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def scratch(df: DataFrame, job: str) -> Scratch:
    return Scratch(df.sparkSession, job)


def whole(text: Column | str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def membership_words(keys: DataFrame, key: str, words: int) -> DataFrame:
    """A bit set of ``words`` 64-bit words over the hashes in ``key``: (word, mask).

    It has at most ``words`` rows, however many keys there are, so it may be broadcast. A
    key that was put in is always found; others now and then.
    """
    at = F.pmod(F.col(key), F.lit(words * 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    return keys.select((at / 64).cast("long").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask"))


def probable_member(key: Column, mask: Column, words: int) -> Column:
    """Whether ``key`` is in the bit set; ``mask`` is the word joined on ``member_word``."""
    bit = (F.pmod(key, F.lit(words * 64)) % 64).cast("int")
    return F.coalesce(F.call_function("shiftrightunsigned", mask, bit).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def member_word(key: Column, words: int) -> Column:
    return (F.pmod(key, F.lit(words * 64)) / 64).cast("long")


FILTER_WORDS = 1 << 17


def without(rows: DataFrame, keys: list[Column], gone: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """``rows`` but those whose keys are in ``gone`` (the same keys, as its columns; null equals null).

    A bit set of fixed size tells the rows that certainly stay: they are passed on where
    they are. Only the others, those that go and a few more, are moved and compared.
    """
    store = scratch(rows, "without")
    names = [f"key_{n}" for n in range(len(keys))]
    gone = store.save(gone.toDF(*names).distinct(), "gone")
    bits = store.save(membership_words(gone.select(F.xxhash64(*names).alias("hash")), "hash", words), "bits")
    keyed = rows.select(F.struct("*").alias("row"), *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    keyed = keyed.withColumn("hash", F.xxhash64(*names)).withColumn("word", member_word(F.col("hash"), words))
    flagged = keyed.join(F.broadcast(bits), "word", "left").withColumn("maybe", probable_member(F.col("hash"), F.col("mask"), words))
    out = gone.toDF(*(f"gone_{n}" for n in range(len(keys))))
    same = F.lit(True)
    for n, name in enumerate(names):
        same = same & F.col(name).eqNullSafe(F.col(f"gone_{n}"))
    compared = flagged.where("maybe").join(out, same, "left_anti")
    return flagged.where("not maybe").select("row").unionByName(compared.select("row")).select("row.*")


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece have about ``most`` bytes together (a longer text stays whole)."""
    for batch in batches:
        rows = batch.num_rows
        begin = size = 0
        for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist() if rows else ()):
            size += n or 0
            if size >= most:
                yield batch.slice(begin, i + 1 - begin)
                begin, size = i + 1, 0
        if begin < rows:
            yield batch.slice(begin)
        del batch  # before the next one is read
