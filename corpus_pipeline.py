"""From raw documents to training sequences: each stage works on what its predecessor kept.

1. toxicity: documents that the class-conditional models find toxic go;
2. exact_dedup: of equal texts the smallest doc_id stays;
3. near_dedup: of documents linked by near-equal fingerprints the smallest doc_id stays, with
   one of its texts if it has several (rows without an id cannot be told apart and stay);
4. packing: token sequences, stored and read back by length.

Null texts are empty: toxicity scores them, exact_dedup keeps one, packing gives the end token
alone. Rows without an id cannot be told apart: they go if they are toxic or equal to a text that
has an id, and stay otherwise. Rows that repeat id and text share their fate. Empty tables pass
through as such.

Every stage but the last returns the columns of ``documents``. Between stages the documents
are a Parquet table in the shared folder, so a lost executor costs a task, not a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import common, exact_dedup, packing, simhash, toxicity
from gleanery.llm.queries import vocabulary

#: Bytes of an Arrow batch. Workers and the JVM's buffers are kept from stage to stage, so a stage leaves less to the next ones.
BATCH = 4 << 20


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark, BATCH)
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def distinct_prints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark, BATCH)
    return simhash.dedup(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark, BATCH)
    # the workers come from the other stages: less text at once keeps them small
    packed = packing.pack(docs, vocabulary("word_bpe_49k.json"), at_once=4 << 20)
    return packing.write_buckets(packed, common.scratch(docs, "packing").path("sequences"))


STAGES = [("toxicity", ordinary), ("exact_dedup", distinct_texts), ("near_dedup", distinct_prints), ("packing", sequences)]

#: Models, XXH64 fingerprints and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    store = common.scratch(docs, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = store.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
