import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleanery.llm import packing
from gleanery.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello, World.", "it's we'LL DON'T 'S '", "É étude naïve Straße ÿ Ÿ", "é Å H̱ K̈",
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <|x|>", "a b c\x1cd\x85e　f", "\x01 \x01a a\x01", "x퟿y \U0001f600 ½²³ ªº ×÷ ¿¡",
    "İstanbul ΣΑΣ ß ẞ ﬁ", "12345 a1b2 v2.0,", "tel. 555-0199; a@b.co %%% ***.###", "\n\t\x0b\x0c\r", "中文字 text かな", "thon " * 9000, "x" * 5000,
]


def test_ids_equal_the_whole_tokenizer(spark):
    whole = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    pieces = {}
    for r in packing.pack(docs, PATH).orderBy("doc_id", "start").collect():
        assert (r.length & (r.length - 1), r.length <= 4096, r.offset) == (0, True, 0)
        got = pieces.setdefault(r.doc_id, [])
        assert r.start == len(got)
        got += np.frombuffer(r.ids, "<u4").tolist()
        assert r.length == len(r.ids) // 4
    for i, t in enumerate(TEXTS):
        assert pieces[i] == [*whole.encode(t or "", add_special_tokens=False).ids, 2], repr(t)[:60]


def test_a_small_memory_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 2000)
    monkeypatch.setattr(packing, "LONGEST", 20)
    import pyarrow as pa

    words = packing.WordIds(PATH)
    texts = [t or "" for t in TEXTS]
    flat, bounds = words.ids(pa.array(texts))
    whole = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_memory_is_bounded_in_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 1 << 20)
    words = packing.WordIds(PATH)
    whole = Tokenizer.from_file(PATH)
    for i in range(12):
        texts = [f"{i}" + "x" * 1_000_000, "\u3000" * 1_000_000, " ".join(f"w{i}k{k} word{k % 7}é{'abcdefghij'[i % 10]}" + chr(97 + k % 26) * (k % 40) for k in range(4000))]
        flat, bounds = words.ids(pa.array(texts))
        assert flat[bounds[2] :].tolist() == whole.encode(texts[2], add_special_tokens=False).ids
        for half in (words.recent, words.older):
            assert half.bytes >= sum(len(p) for p in half.codes) + half.pool.nbytes
            assert half.bytes <= (1 << 19) + 4000 * 260
    assert words.older.codes and words.recent.codes


def test_lookup_holds_numbers_not_pieces():
    import tracemalloc

    import pyarrow as pa

    words = packing.WordIds(PATH)
    texts = pa.array(["some words that are met again, " * 320] * 400)
    words.ids(texts.slice(0, 1))
    tracemalloc.start()
    try:
        flat, bounds = words.ids(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(bounds) == 401 and len(set(np.diff(bounds))) == 1
    assert most < 10 * texts.nbytes  # 20 times when all pieces of a batch were held


def test_long_pieces_are_for_their_batch_alone():
    import pyarrow as pa

    words = packing.WordIds(PATH)
    whole = Tokenizer.from_file(PATH)
    long = ["y" * 300, "-" * 400, "\u3000" * 300]
    for texts in ([*long, "a b", long[1]], ["", "a c"], [long[2] + " b", *long[::-1]], []):
        flat, bounds = words.ids(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(bounds) == len(texts) + 1 and not words.recent.codes.long and not words.recent.codes.new
        assert max(map(len, words.recent.codes)) <= packing.LONGEST and len(words.recent.sizes) == len(words.recent.codes)


def test_random_texts_equal_the_whole_tokenizer():
    import pyarrow as pa

    rng = random.Random(7)
    plain = list("abzZ019'.,-!<|>") + ["'s", "'LL", "É", "ß", "ÿ", " ", "\n", "don't", "I'VE"]
    odd = ["e\u0301", "\u0301", "½", "\u00a0", "\u3000", "<|endoftext|>", "日", "😀", "ﬁ", "İ", "\u200d", "\x85", "\x1c", "\ufeff", "\x7f", "\x00", "×", "º"]
    whole = Tokenizer.from_file(PATH)
    texts = ["".join(rng.choices(plain, k=rng.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(rng.choices(plain * 2 + odd, k=rng.randint(0, 30))) for _ in range(2000)]
    words = packing.WordIds(PATH)
    for begin in range(0, len(texts), 500):
        flat, bounds = words.ids(pa.array(texts[begin : begin + 500]))
        for i, text in enumerate(texts[begin : begin + 500]):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 10_000])
def test_lengths(n):
    cut = packing.lengths(n)
    assert sum(cut) == n and cut == sorted(cut, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 4096 for x in cut)
    assert len(set(x for x in cut if x < 4096)) == len([x for x in cut if x < 4096])


def test_sequences_and_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", 7), (1, "a b c", 8), (None, "d", 9)], "doc_id long, text string, length int")
    packed = packing.pack(docs, PATH)
    rows = packed.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert sorted((str(r.doc_id), r.start, r.length, r.doc_tokens) for r in rows) == [
        ("1", 0, 4, 4), ("1", 0, 4, 4), ("None", 0, 2, 2),
    ]
    back = packing.write_buckets(packed, str(tmp_path / "out"))
    assert sorted(map(str, back.drop("bucket").collect())) == sorted(map(str, rows))
    assert {(r.bucket, r.length) for r in back.collect()} == {(2, 2), (4, 4)}
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"bucket=2", "bucket=4"}
    assert packing.write_buckets(packed.limit(0), str(tmp_path / "none")).count() == 0


def test_digest_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    from pyspark.sql import functions as F

    r = packing.pack(docs, PATH).select("ids", F.crc32("ids").alias("c")).first()
    assert r.c == zlib.crc32(bytes(r.ids))
    assert packing.pack(docs.limit(0), PATH).count() == 0
