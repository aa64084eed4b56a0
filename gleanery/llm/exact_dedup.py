"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after every run of blanks became one space; a null
text is the empty text. Only built-in expressions are used.

1. One scan stores (length, hash of the first characters) of every text. Lengths that occur
   once are done; of the others, prefixes that occur once within their length are done.
2. What is left becomes a bit set of fixed size, which a second scan consults: the full
   content is hashed for rows of surviving groups only (and for the few that the bit set
   lets through by chance, which the exact grouping below puts right).
3. Rows are grouped by length, prefix hash and full hash. Group sizes are summed before the
   shuffle; no group is gathered. The join back to the rows is an equi-join whose hot
   partitions Spark splits.

Nulls: a null doc_id never names a group as long as another id exists; a group of null ids
only has a null keep_id and all its rows are kept. Repeated rows with the same doc_id and
text are one document with several rows: they count in group_size and share ``kept``.
Columns of the input may have any names; they travel inside one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common

PREFIX = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(common.whole(text), common.WHITE, " ")


def _features(docs: DataFrame, text: str) -> DataFrame:
    """The input as struct ``row``, its normalised text and what the first two steps group by."""
    body = docs.select(F.struct("*").alias("row"), normalised(docs[text]).alias("body"))
    return body.select(
        "row", "body", F.octet_length("body").cast("long").alias("size"), F.xxhash64(F.substring("body", 1, PREFIX)).alias("head")
    )


def refine(docs: DataFrame, text: str = "text", words: int = common.FILTER_WORDS) -> DataFrame:
    """Every row with its keys: ``row``, ``body``, ``size``, ``head``, ``full`` (null where no other text can be equal)."""
    store = common.scratch(docs, "exact-dedup")
    features = _features(docs, text)
    thin = store.save(features.select("size", "head"), "features")
    heads = thin.groupBy("size", "head").agg(F.count(F.lit(1)).alias("rows"))
    lengths = heads.groupBy("size").agg(F.sum("rows").alias("n")).where("n > 1").drop("n")
    groups = heads.join(lengths, "size", "left_semi").where("rows > 1")
    survivors = store.save(common.membership_words(groups.select(F.xxhash64("size", "head").alias("key")), "key", words), "survivors")
    key = F.xxhash64("size", "head")
    return (
        features.withColumn("word", common.member_word(key, words))
        .join(F.broadcast(survivors), "word", "left")
        .withColumn("full", F.when(common.probable_member(key, F.col("mask"), words), F.sha2("body", 256)))
        .drop("word", "mask")
    )


def groups(keyed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(size, head, full, keep_id, group_size) of every text that occurs more than once.

    Stored before it is joined, both sides of the join are scans, and Spark can split the
    partition of a large group.
    """
    return (
        keyed.where(F.col("full").isNotNull())
        .groupBy("size", "head", "full")
        .agg(F.min(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def decide(keyed: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``keyed`` with keep_id, group_size and kept."""
    single = F.col("group_size").isNull()
    return keyed.join(found, ["size", "head", "full"], "left").withColumns(
        {
            "keep_id": F.when(single, F.col(doc_id)).otherwise(F.col("keep_id")),
            "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
            "kept": single | F.col(doc_id).eqNullSafe(F.col("keep_id")),
        }
    )


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One thin row per document: doc_id, keep_id, group_size, kept, text_sha256 of its normalised text."""
    keyed = refine(docs, text).select(
        F.col("row")[doc_id].alias("doc_id"), "size", "head", "full", F.sha2("body", 256).alias("text_sha256")
    )
    store = common.scratch(docs, "exact-dedup")
    keyed = store.save(keyed, "keyed")
    return decide(keyed, store.save(groups(keyed), "groups")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    What goes is decided on thin rows, known again by id and hash of the text as it is;
    texts are moved only where they probably go.
    """
    store = common.scratch(docs, "exact-dedup")
    row = F.col("row")
    thin = refine(docs, text).select(
        row[doc_id].alias("own"), F.xxhash64(common.whole(row[text])).alias("raw"), "size", "head", "full"
    )
    thin = store.save(thin, "thin")
    gone = decide(thin, store.save(groups(thin, "own"), "groups"), "own").where(~F.col("kept")).select("own", "raw")
    return common.without(docs, [docs[doc_id], F.xxhash64(common.whole(docs[text]))], gone)
