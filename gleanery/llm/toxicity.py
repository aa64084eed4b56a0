"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of labelled toxic and one of labelled ordinary texts, read a text
word by word (``ORDER`` characters with word marks). Sequences of full length, and those from
the beginning of a word, count as often as they occur; shorter ones, used to back off, count the
different characters they follow. A third model of the same kind is pooled over all documents,
labelled or not: ``SHARED`` pseudo-counts of it go into both classes at every length, so a rare
expression costs both the same. Seen sequences keep the log ratio toxic : ordinary, seen
contexts the log ratio of their back-off weights, as in an ARPA table.

The score compares length-normalised log-likelihoods: the mean log ratio per character over
the whole text, and the mean over its ``STRONGEST`` most telling words (a long ordinary text
does not drown a short insult). A logistic function of the two, fitted on labelled texts
that the models have not counted, gives the score from 0 to 1.

The class models are fitted on at most ``SAMPLE`` labelled texts, chosen by a hash of the id, one
text of a repeated id. The pooled counts cover every text and are made in Spark; the driver takes
them for the sequences of the sample alone, so the sample bounds what it and the broadcast hold.
Every text is scored whole, in Arrow batches, with no shuffle. Words are remembered up to
``REMEMBERED`` characters a task, in two halves of which the older is dropped, and so are the
ratios of ``ENDINGS`` sequences.

Nulls and odd rows: a null or empty text, or one without letters, gets the score of a text
without evidence; a null doc_id is passed on (held_out is null-safe: false); repeated rows
are scored once each; repeated labels of an id count as toxic if any of them does; null
labels are ignored. With no labels of one class every score is 0.5 of no evidence or the
side of the class that is known. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common

ORDER = 5
DISCOUNT = 0.75
SHARED = 2.0
STRONGEST = 2
SAMPLE = 20_000
FOLDS = 5
REMEMBERED = 2 << 20
ENDINGS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, order: int) -> Iterator[str]:
    """For each character of a word, and its end, the longest sequence it ends: ``order`` characters, or from the word's mark."""
    marked = f"^{word}$"
    for end in range(1, len(marked)):
        yield marked[max(0, end - order + 1) : end + 1]


@dataclass
class Ratios:
    """Log ratios toxic : ordinary of seen sequences and of the back-off weights of seen contexts."""

    order: int
    seen: dict[str, float]
    back: dict[str, float]
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    known: dict[str, float] = field(default_factory=dict, repr=False)
    older: dict[str, float] = field(default_factory=dict, repr=False)
    endings: dict[str, float] = field(default_factory=dict, repr=False)
    held: int = 0

    def forget(self) -> None:
        self.known, self.older, self.endings, self.held = {}, {}, {}, 0

    def word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                found = self._ratio(word)
            self.held += len(word)
            if self.held > REMEMBERED // 2:
                self.known, self.older, self.held = {}, self.known, len(word)
            if len(word) <= REMEMBERED // 2:
                self.known[word] = found
        return found

    def _ratio(self, word: str) -> float:
        marked, order, endings = f"^{word}$", self.order, self.endings
        total = 0.0
        for end in range(2, len(marked) + 1):
            gram = marked[end - order if end > order else 0 : end]
            ratio = endings.get(gram)
            total += self._ending(gram) if ratio is None else ratio
        return total

    def _ending(self, gram: str) -> float:
        """Log ratio of a sequence's last character after the others: the longest seen ending, and the back-off to it."""
        total = 0.0
        for begin in range(len(gram)):
            ratio = self.seen.get(gram[begin:])
            if ratio is not None:
                total += ratio
                break
            total += self.back.get(gram[begin:-1], 0.0)
        if len(self.endings) >= ENDINGS:
            self.endings.clear()
        self.endings[gram] = total
        return total

    def evidence(self, text: str | None, strongest: int = STRONGEST) -> tuple[float, float]:
        """Mean log ratio per character, and per word of the strongest words."""
        words = words_of(text or "")
        if not words:
            return 0.0, 0.0
        found = list(map(self.known.get, words))
        if None in found:
            found = [self.word(w) if r is None else r for w, r in zip(words, found, strict=True)]
        each = np.array(found)
        top = np.partition(each, len(each) - strongest)[-strongest:] if len(each) > strongest else each
        return float(each.sum() / sum(map(len, words))), float(top.sum() / strongest)

    def score(self, text: str | None) -> float:
        mean, top = self.evidence(text)
        bias, by_mean, by_top = self.weights
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, bias + by_mean * mean + by_top * top))))


def ratios(counts: Iterable[tuple[str, int, int, int, int, int]], order: int = ORDER) -> Ratios:
    """The two models' log ratios from the rows of ``sequences`` that occur in a class."""
    rows = sorted(counts, key=lambda r: len(r[0]))
    totals = defaultdict(lambda: [0, 0])
    kinds = defaultdict(lambda: [0, 0])
    for gram, *both, _, _, _ in rows:
        for y in (0, 1):
            totals[gram[:-1]][y] += both[y]
            kinds[gram[:-1]][y] += both[y] > 0
    pooled: dict[str, float] = {}
    own: dict[str, tuple[float, float]] = {}
    seen: dict[str, float] = {}
    for gram, ordinary, toxic, n, total, different in rows:
        context, shorter = gram[:-1], gram[1:]
        if context:
            pooled[gram] = (max(n - DISCOUNT, 0) + DISCOUNT * different * pooled[shorter]) / total
        else:
            pooled[gram] = n / total
        pair = []
        for y, count in enumerate((ordinary, toxic)):
            mass = max(count - DISCOUNT, 0) + DISCOUNT * kinds[context][y] * own[shorter][y] if context else count
            pair.append((mass + SHARED * pooled[gram]) / (totals[context][y] + SHARED))
        own[gram] = (pair[0], pair[1])
        seen[gram] = math.log(pair[1] / pair[0])
    back = {}
    for context, total in totals.items():
        if context:
            ordinary, toxic = ((DISCOUNT * kinds[context][y] + SHARED) / (total[y] + SHARED) for y in (0, 1))
            back[context] = math.log(toxic / ordinary)
    return Ratios(order, seen, back)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> tuple[float, ...]:
    """Weights (bias first) of a logistic regression with a small penalty, by Newton steps on scaled inputs."""
    scale = x.std(axis=0) + 1e-9
    inputs = np.column_stack([np.ones(len(x)), x / scale])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]]) * len(x)
    w = np.zeros(inputs.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(inputs @ w, -30, 30)))
        step = np.linalg.solve(inputs.T @ (inputs * (p * (1 - p))[:, None]) + penalty, inputs.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), *(float(v) for v in w[1:] / scale))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, most: int, folds: int) -> DataFrame:
    """(doc_id, text, toxic, fits) of at most ``most`` labelled texts outside the held-out fold, one per id."""
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(~held_out(F.col("doc_id"), folds))
        .orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
        .limit(most)
    )
    fits = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(folds)) != 0
    texts = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return texts.select("doc_id", "text", "toxic", fits.alias("fits"))


_KINDS = ("ordinary", "toxic", "pooled")


def _counted(key: str, kind: int, counts: Mapping[str, int]) -> pa.RecordBatch:
    """Rows of one kind."""
    n, none = pa.array(counts.values(), pa.int64(), size=len(counts)), pa.array(np.zeros(len(counts), np.int64))
    columns = [n if k == kind else none for k in range(len(_KINDS))]
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string(), size=len(counts)), *columns], [key, *_KINDS])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts by kind: 0 ordinary, 1 toxic, 2 pooled."""
    for batch in common.slices(batches, "text"):
        found = tuple(Counter() for _ in _KINDS)
        for text, kind in zip(batch.column("text").to_pylist(), batch.column("kind").to_pylist(), strict=True):
            found[kind].update(words_of(text))
        for kind, counts in enumerate(found):
            if counts:
                yield _counted("word", kind, counts)


def _gram_counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            for kind, name in enumerate(_KINDS):
                counts: dict[str, int] = defaultdict(int)
                for word, n in zip(words, batch.column(name).to_pylist(), strict=True):
                    if n:
                        for gram in grams_of(word, order):
                            counts[gram] += n
                if counts:
                    yield _counted("gram", kind, counts)

    return run


def sequences(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ordinary, toxic, pooled, total, different): Kneser-Ney counts of texts (text, kind as in ``_word_counts``).

    A sequence of ``order`` characters or from a word's mark counts its occurrences, any shorter
    one the different characters that it follows, per class and over all. ``total`` and
    ``different`` are the sum of ``pooled`` and the number of sequences with the same context.
    """
    if order < 2:
        raise ValueError("a context needs a character")
    longs = ", ".join(f"{k} long" for k in _KINDS)
    sums = [F.sum(k).alias(k) for k in _KINDS]
    words = texts.mapInArrow(_word_counts, f"word string, {longs}").groupBy("word").agg(*sums)
    longest = words.mapInArrow(_gram_counts(order), f"gram string, {longs}").groupBy("gram").agg(*sums)
    longest = common.scratch(texts, "toxicity").save(longest, "longest")
    ends = F.transform(F.sequence(F.lit(2), F.length("gram")), lambda n: F.right(F.col("gram"), n))
    met = longest.select(F.explode(ends).alias("end"), *((F.col(k) > 0).cast("long").alias(k) for k in _KINDS))
    met = met.groupBy("end").agg(*(F.max(k).alias(k) for k in _KINDS))
    shorter = met.groupBy(F.expr("substring(end, 2)").alias("gram")).agg(*sums)
    both = longest.unionByName(shorter).withColumn("context", F.expr("left(gram, length(gram) - 1)"))
    contexts = both.groupBy("context").agg(F.sum("pooled").alias("total"), F.count("*").alias("different"))
    return both.join(contexts, "context").select("gram", *_KINDS, "total", "different")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, order: int = ORDER, folds: int = FOLDS) -> Ratios:
    """Models and weights from documents (doc_id, text) and labels (doc_id, toxic)."""
    docs = docs.select(docs["doc_id"], common.whole(docs["text"]).alias("text"))
    labels = labels.select(labels["doc_id"], labels["toxic"])
    sample = common.scratch(docs, "toxicity").save(_sample(docs, labels, most, folds), "sample")
    kinds = sample.where("fits").select("text", (F.col("toxic") > 0).cast("int").alias("kind"))
    counts = sequences(kinds.unionByName(docs.select("text", F.lit(2).alias("kind"))), order)
    model = ratios(map(tuple, counts.where("ordinary + toxic > 0").toLocalIterator()), order)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = [shared.value.evidence(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)] + [batch.column("toxic").cast(pa.int64())],
                ["mean", "top", "toxic"],
            )

    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = sample.where("not fits").select("text", "toxic").mapInArrow(evidence, "mean double, top double, toxic long").collect()
    x, y = np.array([(r.mean, r.top) for r in rows]).reshape(-1, 2), np.array([float(r.toxic > 0) for r in rows])
    if len(rows) and 0 < y.sum() < len(y):
        model.weights = logistic(x, y)
    else:
        model.weights = (-4.0, 0.0, 0.5)  # too few labels to weigh: even odds need strong words
    shared.unpersist()
    return model


def score(docs: DataFrame, model: Ratios, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in common.slices(batches, "text"):
            found = pa.array([own.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "score"])
        own.forget()  # the worker goes on to other tasks

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), common.whole(docs[text]).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_ordinary(docs: DataFrame, model: Ratios, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below one half, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield texts.map(own.score)
        own.forget()  # the worker goes on to other tasks

    return docs.where(score_of(common.whole(docs[text])) < 0.5)
