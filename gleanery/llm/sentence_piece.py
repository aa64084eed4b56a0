"""SentencePiece encoding and decoding on the tokenizers library.

``parse`` reads the model file (a protobuf message); ``build`` makes a tokenizer of it: the
normaliser (character map, blanks), the word marker for spaces, unigram scores or the merges
that the scores of a BPE model imply, and byte fallback. ``encode`` and ``decode`` run it in
Arrow batches, several threads a task.

Where no piece has the word marker after another character, no piece can reach across the
beginning of a word, so a text's ids are those of its words one after another. A task then
encodes each distinct word once (up to ``REMEMBERED`` at a time), many words in one call,
parted by a character that no piece contains. Other models encode whole texts.

Parity is verified on everything that is encoded: the original library encodes the same
words (or texts) without its own prefix, and where the ids differ, its ids count and the
document is flagged. Decoding the ids must also give the words back.

Nulls and odd rows: a null or empty text has no ids; null ids decode to an empty text; a
null doc_id is passed on; repeated rows are encoded once each; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm import common

REMEMBERED = 300_000
TOGETHER = 256
THREADS = 2

MARK = "▁"
# Field numbers and kinds of the model message.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data):
                raise ValueError("the model file is cut off")
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError("not a model file")
        size = {1: 8, 5: 4}.get(kind) or 0
        if kind == 2:
            size = varint()
        if at + size > len(data):
            raise ValueError("the model file is cut off")
        yield key >> 3, data[at : at + size]
        at += size


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = _UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    bare: bytes = field(default=b"", repr=False)

    def ids(self, *kinds: int) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k in kinds]


def parse(data: bytes) -> Model:
    """The model; ``bare`` is the same file with a normaliser that changes nothing."""
    model, rest = Model(), []
    for number, value in message(data):
        if number == 1:
            piece, score, kind = "", 0.0, _NORMAL
            for n, v in message(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append(piece)
            model.scores.append(score)
            model.kinds.append(kind)
        elif number == 2:
            spec = dict(message(value))
            model.kind = spec.get(3, _UNIGRAM)
            model.byte_fallback, model.suffix = bool(spec.get(35, 0)), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(message(value))
            model.charsmap = spec.get(2, b"")
            model.prefix, model.squeeze, model.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
            continue
        if isinstance(value, bytes):
            rest.append(_number(number << 3 | 2) + _number(len(value)) + value)
    if model.kind not in (_UNIGRAM, _BPE) or model.suffix or not model.escape:
        raise ValueError("only unigram and BPE models with the marker before the word")
    plain = b"".join(_number(n << 3) + b"\0" for n in (3, 4)) + _number(5 << 3) + b"\1"
    model.bare = b"".join(rest) + _number(3 << 3 | 2) + _number(len(plain)) + plain
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """The merges of a BPE model: every way to make a piece of two others, best pieces first."""
    at = {p: i for i, p in enumerate(model.pieces)}
    found = []
    for i in model.ids(_NORMAL):
        piece = model.pieces[i]
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in at and right in at:
                found.append((-model.scores[i], at[left], at[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(model: Model, normalise: bool = True):
    """A tokenizer of the tokenizers library; without ``normalise`` it takes marked text."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unknown = model.ids(_UNKNOWN)
    if model.kind == _BPE:
        core = models.BPE(
            {p: i for i, p in enumerate(model.pieces)}, merges(model), unk_token=model.pieces[unknown[0]] if unknown else None,
            fuse_unk=True, byte_fallback=model.byte_fallback,
        )
    else:
        # control pieces must not be found in a text: U+FDD0 is no character
        hidden = {i: "﷐" + model.pieces[i] for i in model.ids(_CONTROL, _UNUSED)}
        vocabulary = [(hidden.get(i, p), s) for i, (p, s) in enumerate(zip(model.pieces, model.scores, strict=True))]
        core = models.Unigram(vocabulary, unk_id=unknown[0] if unknown else None, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    tokenizer.add_tokens([AddedToken(model.pieces[i], normalized=False) for i in model.ids(_USER)])
    if normalise:
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if model.prefix:
            steps.append(normalizers.Prepend(MARK))
        tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    decoding = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if normalise and (model.prefix or model.squeeze):
        decoding.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(decoding)
    return tokenizer


class Codec:
    """A model loaded once per process, with the words it has met."""

    _loaded: dict[tuple[str, int], Codec] = {}

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import normalizers

        self.threads = threads
        self.model = parse(data)
        self.bare, self.full = build(self.model, False), build(self.model)
        self.original = SentencePieceProcessor(model_proto=self.model.bare)
        self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.hidden = np.array(self.model.ids(_CONTROL, _UNUSED), np.int64)
        normal = [self.model.pieces[i] for i in self.model.ids(_NORMAL)]
        self.by_word = not self.model.ids(_USER) and all(MARK not in p.lstrip(MARK) for p in normal)
        # a line feed parts words where it is always one byte token
        feed = f"<0x{10:02X}>"
        parted = self.by_word and self.model.byte_fallback and feed in self.model.pieces and not any("\n" in p for p in normal)
        self.feed = self.model.pieces.index(feed) if parted else None
        self.words = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if parted else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.lost: set[str] = set()

    @classmethod
    def load(cls, path: str, threads: int) -> Codec:
        key = (path, threads)
        if key not in cls._loaded:
            with open(path, "rb") as file:
                cls._loaded[key] = cls(file.read(), threads)
        return cls._loaded[key]

    def marked(self, text: str) -> str:
        """The normalised text with word markers."""
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" {2,}", " ", text).strip(" ")
        return (MARK + text if self.model.prefix and text else text).replace(" ", MARK)

    def _verified(self, texts: list[str]) -> list[tuple[list[int], bool, bool]]:
        """Ids of marked texts, whether both libraries agree, whether decoding gives the text back."""
        own = [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.original.encode(texts, num_threads=self.threads)
        back = self.bare.decode_batch(theirs, skip_special_tokens=False)
        return [(b, a == b, t.replace(MARK, " ") == d) for t, a, b, d in zip(texts, own, theirs, back, strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Ids of words not met yet; many words make one text where a line feed parts them."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
            self.odd.clear()
            self.lost.clear()
        single = words
        if self.feed is not None:
            groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
            single = []
            for group, (ids, same, faithful) in zip(groups, self._verified(["\n".join(g) for g in groups]), strict=True):
                flat = np.array(ids, "<u4")
                cuts = np.flatnonzero(flat == self.feed)
                if not same or not faithful or len(cuts) != len(group) - 1:
                    single += group
                    continue
                begins, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(flat)]
                for word, begin, end in zip(group, begins, ends, strict=True):
                    self.known[word] = flat[begin:end].tobytes()
        for word, (ids, same, faithful) in zip(single, self._verified(single), strict=True):
            self.known[word] = np.array(ids, "<u4").tobytes()
            if not same:
                self.odd.add(word)
            if not faithful:
                self.lost.add(word)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """Ids (unsigned 32-bit, little-endian), parity and whether decoding restores the normalised text."""
        if not self.by_word:
            marked = [self.marked(t) for t in texts]
            return [(np.array(ids, "<u4").tobytes(), same, faithful) for ids, same, faithful in self._verified(marked)]
        cut = [self.words.findall(self.marked(t)) for t in texts]
        new = list(set().union(*cut).difference(self.known, ("\n",) if self.feed is not None else ()))
        if len(self.known) + len(new) > REMEMBERED:  # what is known is forgotten before it is needed
            new = list(set().union(*cut).difference(("\n",) if self.feed is not None else ()))
        self._learn(new)
        known = self.known
        if self.feed is not None:
            known["\n"] = np.array([self.feed], "<u4").tobytes()
        odd, lost = self.odd, self.lost
        return [
            (b"".join(map(known.__getitem__, c)), not odd or odd.isdisjoint(c), not lost or lost.isdisjoint(c)) for c in cut
        ]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids; control pieces say nothing."""
        said = [x[~np.isin(x, self.hidden)].tolist() for x in ids]
        return self.full.decode_batch(said, skip_special_tokens=False)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", threads: int = THREADS) -> DataFrame:
    """One row per document: doc_id, ids (binary, unsigned 32-bit little-endian), parity, restored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path, threads)
        for batch in common.slices(batches, "text", 4 << 20):
            found = codec.encode(batch.column("text").to_pylist())
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.binary(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "ids", "parity", "restored"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), common.whole(docs[text]).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, parity boolean, restored boolean")


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids", threads: int = THREADS) -> DataFrame:
    """One row per row of ids: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path, threads)
        for batch in common.slices(batches, "ids", 4 << 20):
            texts = codec.decode([np.frombuffer(x or b"", "<u4") for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(encoded[doc_id].cast("long").alias("doc_id"), encoded[ids].cast("binary").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
