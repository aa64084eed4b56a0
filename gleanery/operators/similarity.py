"""Lossless similarity join on Ratcliff/Obershelp ratio.

The ratio of two keys of total length T is 2M/T, M the characters in matching blocks.
For ratio >= t at most u = T - 2 * ceil(t * T / 2) characters are left unmatched, so these
follow and can be tested without losing a pair:

* the lengths differ by at most u;
* the multisets of characters differ by at most u;
* at most u + 1 blocks hold the M characters and a block of m has m - 1 bigrams, so the
  multisets of bigrams differ by at most 3u;
* the blocks are a common subsequence, so the longest one has at least M characters.

A key carries how often it holds the characters that vary most, and bits "holds this bigram at
least so many times".  Two keys differ in no more than their multisets do, whichever characters
and bits are taken; of the bits those that about half of some keys have, because they tell most
keys apart.

Keys are dealt to parts, and a cell of the grid compares one part with another.  A cell needs the
memory of its two parts.  All pairs meet, as an exact join at this threshold needs for keys that
resemble nothing: what the counts of two characters each differ in stands in tables, and a target
needs one addition of bytes for two characters and a probe.  Bigrams and common subsequences are measured for what is left, of several
targets together, and the ratio is computed for what is left then.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.85
SALT_ROWS = 1 << 17  # keys of a part
CELLS = 64  # cells that a join of some size has at least, to spread its work
LEAST_ROWS = 12_000  # keys of a part below which it is not split to that end: a target costs some time of its own in every part
LEAST_TOLD = 6_000  # the same of keys that are compared with each other
LEAST_TARGETS = 500  # the same of targets, where these are dealt instead
CHARACTERS, BIGRAMS = 128, 1024  # what characters and bigrams are hashed to
COLUMNS, WORDS = 48, 8  # characters counted at most, and 64-bit words of bits on bigrams
_CHOSEN_FROM = 4096  # keys that the choice of both looks at; it steers the work, never the result
_LOOKED_AT = 1000  # their characters it looks at
_LEVELS = 8  # counts of a character that are told apart: so many around the usual one
_PROBES = 1 << 16  # that share tables of differences
_TARGETS = 256  # looked at together
_ROWS = 16  # of them that have their results found together
_CHUNK = 1 << 16  # probes of a cell that have tables at a time
_LONGEST = 1024  # characters of a key up to which a table of characters is held for vectors
_AT_ONCE = 8192
_EPSILON = 1e-9


def _check(threshold: float) -> None:
    if not 0.8 < threshold <= 1:
        raise ValueError("the bigram bound needs a threshold above 0.8")


def unmatched(total: np.ndarray | int, threshold: float) -> np.ndarray:
    """Characters two keys of this total length may leave unmatched."""
    total = np.asarray(total)
    return total - 2 * np.ceil(total * (threshold / 2) - _EPSILON).astype(np.int64)


def _counts(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per key how often it holds each hashed character and bigram."""
    n = np.array([len(k) for k in keys], np.int64)
    codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(keys)), n)
    chars = np.bincount(row * CHARACTERS + codes % CHARACTERS, minlength=len(keys) * CHARACTERS)
    pair = row[1:] == row[:-1]
    slot = (codes[:-1] * 1_000_003 + codes[1:] * 8191)[pair] % 1_000_000_007 % BIGRAMS
    grams = np.bincount(row[1:][pair] * BIGRAMS + slot, minlength=len(keys) * BIGRAMS)
    return chars.reshape(len(keys), CHARACTERS), grams.reshape(len(keys), BIGRAMS)


def _choose(keys: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Hashed characters to count, and (hashed values, times) of the bits on bigrams, the most telling first."""
    total, squares = np.zeros(CHARACTERS), np.zeros(CHARACTERS)
    seen: dict[tuple[int, int], int] = {}
    for at in range(0, len(keys), 1000):
        chars, grams = _counts(keys[at : at + 1000])
        total, squares = total + chars.sum(0), squares + (chars**2).sum(0)
        for times in range(1, min(int(grams.max(initial=0)), 64) + 1):
            having = (grams >= times).sum(0)
            for value in np.flatnonzero(having):
                seen[int(value), times] = seen.get((int(value), times), 0) + int(having[value])
    varies = squares * len(keys) - total**2
    columns = np.argsort(-varies, kind="stable")[: max(min(COLUMNS, int((varies > 0).sum())), 2)]
    told = sorted(seen, key=lambda bit: (abs(2 * seen[bit] - len(keys)), bit))[: WORDS * 64]
    told += [(0, 1 << 30)] * (WORDS * 64 - len(told))  # bits nobody has
    values, times = zip(*told, strict=True)
    return columns, (np.array(values), np.array(times))


def _signed(columns: np.ndarray, bits: tuple[np.ndarray, np.ndarray]):
    values, times = bits

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys = [k or "" for k in part.column("key").to_pylist()]
                chars, grams = _counts(keys)
                held = np.hstack([np.minimum(chars[:, columns], 255).astype(np.uint8), np.packbits(grams[:, values] >= times, axis=1)])
                out = [part.column("kid"), part.column("key"), pa.array([len(k) for k in keys], pa.int32()), pa.array([h.tobytes() for h in held], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["kid", "key", "n", "bits"])

    return sign


def profile(keys: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Keys with all that the join needs: (kid, key, n, bits, salts).

    ``bits`` has the counts of characters, a byte each, and then the bits on bigrams.  ``salts`` holds the number of parts that so many keys are dealt to.  The count and at most
    _CHOSEN_FROM keys, cut to _LOOKED_AT characters, come to the driver.
    """
    _check(threshold)
    looked = keys.select(F.coalesce(F.substring("key", 1, _LOOKED_AT), F.lit("")).alias("key"), F.xxhash64("kid").alias("_h"))
    columns, bits = _choose([r.key for r in looked.orderBy("_h").limit(_CHOSEN_FROM).collect()])
    parts = max(math.ceil(keys.count() / SALT_ROWS), 1)
    signed = keys.select("kid", "key").mapInArrow(_signed(columns, bits), "kid long, key string, n int, bits binary")
    return signed.withColumn("salts", F.array(F.lit(parts)))


class _Side:
    """The keys of a cell's side, ordered by length or number."""

    def __init__(self, table: pa.Table, by: str):
        table = table.sort_by(by)
        self.kid = table.column("kid").to_numpy()
        self.n = table.column("n").to_numpy().astype(np.int64)
        self.keys = [k or "" for k in table.column("key").to_pylist()]
        self.once = table.column("_once").to_numpy(zero_copy_only=False) if "_once" in table.column_names else None
        raw = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8)
        held = raw.reshape(len(self.kid), -1) if len(self.kid) else raw.reshape(0, WORDS * 8)
        self.counts = np.ascontiguousarray(held[:, : held.shape[1] - WORDS * 8])
        self.words = np.ascontiguousarray(held[:, held.shape[1] - WORDS * 8 :]).view(np.uint64)

    def take(self, chosen: slice | np.ndarray) -> _Side:
        """Some of the keys, given by a slice or by whether each is taken."""
        out = object.__new__(_Side)
        out.kid, out.n, out.counts, out.words = self.kid[chosen], self.n[chosen], self.counts[chosen], self.words[chosen]
        out.once = None if self.once is None else self.once[chosen]
        out.keys = self.keys[chosen] if isinstance(chosen, slice) else [self.keys[i] for i in np.flatnonzero(chosen)]
        return out

    def chunks(self) -> Iterator[_Side]:
        for at in range(0, len(self.kid), _CHUNK):
            yield self.take(slice(at, at + _CHUNK))


class _Apart:
    """How much the counts of characters of each probe (ordered by length) differ from a target's.

    Counts are clipped to some levels, which brings none further apart.  Two characters each have
    a table of what probes differ in by the target's two levels, a byte for a probe; a difference
    above 255 comes out lower than it is.
    """

    def __init__(self, probes: _Side, threshold: float):
        n, characters = probes.counts.shape
        self.n, self.threshold = probes.n, threshold
        self.low = np.maximum(np.median(probes.counts, axis=0).astype(np.int64) - _LEVELS // 2 + 1, 0) if n else np.zeros(characters, np.int64)
        levels = self.levels(probes.counts)
        self.pairs = levels.shape[1] // 2
        told = np.arange(_LEVELS, dtype=np.int8)[:, None]
        self.parts = []
        for at in range(0, n, _PROBES):
            part = np.ascontiguousarray(levels[at : at + _PROBES].T)
            apart = [np.abs(told - level).astype(np.uint8) for level in part]
            tables = [(x[:, None] + y).reshape(_LEVELS * _LEVELS, -1) for x, y in zip(apart[::2], apart[1::2], strict=True)]
            room = np.empty(part.shape[1], np.uint8)
            self.parts.append((at, tables, room, np.zeros((_ROWS, -(-len(room) // 64) * 64), bool)))
        self.bounds: dict[int, tuple[int, int, np.ndarray]] = {}

    def levels(self, counts: np.ndarray) -> np.ndarray:
        levels = np.clip(counts.astype(np.int64) - self.low, 0, _LEVELS - 1).astype(np.int8)
        return np.pad(levels, ((0, 0), (0, levels.shape[1] % 2)))

    def _bounds(self, length: int) -> tuple[int, int, np.ndarray]:
        """First and last probe of a length that fits a target of this one, and what may be unmatched with each."""
        if length not in self.bounds:
            if len(self.bounds) >= 64:
                self.bounds.clear()
            most = unmatched(self.n + length, self.threshold)
            fits = np.flatnonzero((np.abs(self.n - length) <= most) & (self.n > 0))
            first, last = (int(fits[0]), int(fits[-1]) + 1) if len(fits) and length else (0, 0)
            self.bounds[length] = first, last, np.clip(most, 0, 255).astype(np.uint8)
        return self.bounds[length]

    def near(self, counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(target, probe) of those that differ by no more than may be unmatched, ordered by target."""
        levels = self.levels(counts).astype(np.int64)
        places = (levels[:, ::2] * _LEVELS + levels[:, 1::2]).tolist()
        bounds = [self._bounds(length) for length in lengths.tolist()]
        targets, probes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for start, tables, room, kept in self.parts:
            n = len(room)
            for at in range(0, len(lengths), len(kept)):
                some = kept[: len(lengths) - at]
                for i, told in enumerate(some, at):
                    first, last, most = bounds[i]
                    a, b = max(first - start, 0), min(last - start, n)
                    if a >= b:
                        told[:] = False
                        continue
                    if a or b < told.size:
                        told[:a] = told[b:] = False
                    place, apart = places[i], room[a:b]
                    np.add(tables[0][place[0], a:b], tables[1][place[1], a:b] if self.pairs > 1 else 0, out=apart)
                    for pair in range(2, self.pairs):
                        np.add(apart, tables[pair][place[pair], a:b], out=apart)
                    np.less_equal(apart, most[start + a : start + b], out=told[a:b])
                words = np.packbits(some).view(np.uint64)  # few of all are left: 64 are passed over at once
                filled = words.nonzero()[0]
                word, bit = np.divmod(np.unpackbits(words[filled].view(np.uint8)).nonzero()[0], 64)
                target, probe = np.divmod(filled[word] * 64 + bit, some.shape[1])
                targets.append(target + at), probes.append(probe + start)
        target, probe = np.concatenate(targets), np.concatenate(probes)
        if len(self.parts) > 1:
            order = np.argsort(target, kind="stable")
            target, probe = target[order], probe[order]
        return target, probe


def _bytes_summed(rows: np.ndarray) -> np.ndarray:
    """The sum of each row of bytes, up to 128 columns."""
    some, even = np.zeros(len(rows), np.uint64), np.uint64(0x00FF00FF00FF00FF)
    for at in range(0, rows.shape[1], 8):
        part = rows[:, at : at + 8]
        if part.shape[1] < 8:
            part = np.pad(part, ((0, 0), (0, 8 - part.shape[1])))
        eight = np.ascontiguousarray(part).view(np.uint64)[:, 0]
        some += eight & even
        some += eight >> np.uint64(8) & even
    return (some * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)


class _Filter:
    """Probes (ordered by length) that may be similar to some targets."""

    def __init__(self, probes: _Side, targets: _Side, threshold: float):
        self.probes, self.targets, self.threshold = probes, targets, threshold
        self.apart = _Apart(probes, threshold)
        longest = int(probes.n.max(initial=0))
        self.most = unmatched(np.arange(longest + int(targets.n.max(initial=0)) + 1), threshold)
        self.codes = _codes(probes.keys, longest) if longest <= _LONGEST else None

    def near(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(target, probe) of these targets that pass by characters, ordered by target."""
        target, probe = self.apart.near(self.targets.counts[targets], self.targets.n[targets])
        return targets[target], probe

    def alike(self, target: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that pass by bigrams and by their longest common subsequence."""
        kept = [self._alike(target[at : at + _AT_ONCE], probe[at : at + _AT_ONCE]) for at in range(0, len(target), _AT_ONCE)]
        kept = np.concatenate(kept) if kept else np.empty(0, bool)
        return target[kept], probe[kept]

    def _alike(self, target: np.ndarray, probe: np.ndarray) -> np.ndarray:
        total = self.targets.n[target] + self.probes.n[probe]
        most = self.most[total]
        apart = self.targets.words.take(target, 0)
        apart ^= self.probes.words.take(probe, 0)
        left = np.flatnonzero(_bytes_summed(np.bitwise_count(apart)) <= 3 * most)
        counts, others = self.targets.counts.take(target[left], 0), self.probes.counts.take(probe[left], 0)
        apart = np.maximum(counts, others) - np.minimum(counts, others)
        left = left[_bytes_summed(apart) <= most[left]]
        least = (total - most) // 2
        left = left[self._common(target[left], probe[left], least[left]) >= least[left]]
        kept = np.zeros(len(target), bool)
        kept[left] = True
        return kept

    def _common(self, target: np.ndarray, probe: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each pair, or less than ``least`` if it is."""
        common = np.zeros(len(target), np.int64)
        words = -(-self.targets.n[target] // 64)
        plain = words > (_LONGEST // 64 if self.codes is not None else 0)
        masks: dict[str, int] = {}
        last = -1
        for i in np.flatnonzero(plain).tolist():
            key = self.targets.keys[target[i]]
            if target[i] != last:
                masks, last = {}, target[i]
                for place, c in enumerate(key):
                    masks[c] = masks.get(c, 0) | 1 << place
            common[i] = _subsequence(masks, len(key), self.probes.keys[probe[i]])
        for size in np.unique(words[~plain]).tolist():
            at = np.flatnonzero(~plain & (words == size))
            some, row = np.unique(target[at], return_inverse=True)
            n = self.targets.n[some]
            codes = _codes([self.targets.keys[i] for i in some], int(n.max()))
            length = self.probes.n[probe[at]]
            common[at] = _subsequences_of(codes, n, row, self.codes[probe[at], : int(length.max())].T, length, least[at])
        return common


def _codes(keys: list[str], width: int) -> np.ndarray:
    """A row of hashed characters per key, 255 where it has ended."""
    n = np.array([len(k) for k in keys], np.int64)
    out = np.full((len(keys), width), 255, np.uint8)
    told = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(width) < n[:, None]] = told % 251
    return out


def _subsequence(masks: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of a key of n characters, given by their places, and another."""
    full = open_ = (1 << n) - 1
    for c in other:
        mask = masks.get(c)
        if mask:
            met = open_ & mask
            open_ = (open_ + met | open_ - met) & full
    return n - open_.bit_count()


def _subsequences(key: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The same of one key and the columns of ``others``."""
    return _subsequences_of(key[None], np.array([len(key)]), np.zeros(others.shape[1], np.int64), others)


def _subsequences_of(
    keys: np.ndarray, n: np.ndarray, row: np.ndarray, others: np.ndarray, length: np.ndarray | None = None, least: np.ndarray | None = None
) -> np.ndarray:
    """The same of pairs: a row of ``keys`` (so many characters of it) and a column of ``others`` each, as 64-bit words with carry.

    With their ``length``, a pair that can't come to ``least`` any more is given up and has 0.  Of the
    first j characters of a column at most length - least may be left out, and what they have in
    common with the key lies within its first j + n - least.
    """
    words = -(-keys.shape[1] // 64)
    table = np.zeros((words, len(keys) * 256), np.uint64)
    which, place = np.nonzero(np.arange(keys.shape[1]) < n[:, None])
    bit = np.uint64(1) << (place % 64).astype(np.uint64)
    np.bitwise_or.at(table, (place // 64, which * 256 + keys[which, place]), bit)
    open_ = np.full((words, len(row)), ~np.uint64(0))
    others, start, n, left = np.ascontiguousarray(others), row.astype(np.int64) * 256, n[row], np.arange(len(row))
    common = np.zeros(len(row), np.int64)
    looks = () if least is None else {len(others) * eighths // 8 for eighths in (2, 3, 4, 5, 6)}
    for j in range(len(others)):
        if j in looks:
            first = _first_bits(np.minimum(j + n - least, n), words)
            held = np.bitwise_count(~open_ & first).sum(0, dtype=np.int64)
            kept = held >= np.minimum(j, length) - (length - least)
            if 4 * np.count_nonzero(kept) < 3 * len(kept):
                open_, others, start, n, left = np.ascontiguousarray(open_[:, kept]), np.ascontiguousarray(others[:, kept]), start[kept], n[kept], left[kept]
                length, least = length[kept], least[kept]
        at, carry = start + others[j], None
        for w in range(words):
            before = open_[w]
            met = table[w].take(at)
            met &= before
            total = before + met
            if w + 1 < words or carry is not None:
                over = total < before
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64) if w + 1 < words else None
            before ^= met
            before |= total
    common[left] = np.bitwise_count(~open_ & _first_bits(n, words)).sum(0, dtype=np.int64)
    return common


def _first_bits(n: np.ndarray, words: int) -> np.ndarray:
    """Words of which so many bits are set, from the lowest one of the first word on."""
    held = np.clip(n - np.arange(words)[:, None] * 64, 0, 64)
    return np.where(held > 0, ~np.uint64(0) >> np.where(held > 0, 64 - held, 0).astype(np.uint64), np.uint64(0))


def _sides(table: pa.Table) -> tuple[_Side, _Side]:
    on_probes = table.column("_side").to_numpy() == 0
    return _Side(table.filter(pa.array(on_probes)), "n"), _Side(table.filter(pa.array(~on_probes)), "kid")


def _pairs_of(threshold: float):
    """All pairs of a cell that pass; two targets of one part come out once."""

    def run(table: pa.Table) -> pa.Table:
        side, targets = _sides(table)
        kids: list[tuple[int, int]] = []
        later, earlier = [], []
        for probes in side.chunks():
            filtered = _Filter(probes, targets, threshold)
            for at in range(0, len(targets.kid), _TARGETS):
                t, p = filtered.near(np.arange(at, min(at + _TARGETS, len(targets.kid))))
                one, other = targets.kid[t], probes.kid[p]
                kept = (other != one) & (~probes.once[p] | (other > one))
                for i, j in zip(*(x.tolist() for x in filtered.alike(t[kept], p[kept])), strict=True):
                    mine, his = (int(probes.kid[j]), probes.keys[j]), (int(targets.kid[i]), targets.keys[i])
                    (low, first), (high, second) = (his, mine) if mine[0] > his[0] else (mine, his)
                    kids.append((low, high)), later.append(second), earlier.append(first)
        lo, hi = zip(*kids, strict=True) if kids else ((), ())
        arrays = [pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(later, pa.string()), pa.array(earlier, pa.string())]
        return pa.Table.from_arrays(arrays, ["lo", "hi", "later", "earlier"])

    return run


class _Leading:
    """Gives probes of a part to targets that come up in the order of their numbers."""

    def __init__(self, threshold: float):
        self.threshold, self.matcher = threshold, SequenceMatcher(None)
        self.kids: list[int] = []
        self.leaders: list[int] = []

    def table(self) -> pa.Table:
        return pa.Table.from_arrays([pa.array(self.kids, pa.int64()), pa.array(self.leaders, pa.int64())], ["kid", "leader"])

    def _give(self, filtered: _Filter, target: np.ndarray, probe: np.ndarray, covered: np.ndarray, place: np.ndarray | None) -> None:
        """Probes that are similar and not covered go to the first of their targets; a target that is covered takes none."""
        probes, targets = filtered.probes, filtered.targets
        last = -1
        for i, j in zip(*(x.tolist() for x in filtered.alike(target, probe)), strict=True):
            if covered[j] or place is not None and covered[place[i]]:
                continue
            if i != last:
                self.matcher.set_seq2(targets.keys[i])
                last = i
            self.matcher.set_seq1(probes.keys[j])
            if self.matcher.ratio() >= self.threshold:
                covered[j] = True
                self.kids.append(int(probes.kid[j])), self.leaders.append(int(targets.kid[i]))

    def nearest(self, probes: _Side, targets: _Side) -> None:
        """Every probe to the lowest target before it that it is similar to, if there is one."""
        covered, filtered = np.zeros(len(probes.kid), bool), _Filter(probes, targets, self.threshold)
        at, many = 0, 1
        while at < len(targets.kid) and len(probes.kid):
            found: list[tuple[np.ndarray, np.ndarray]] = []
            left = _AT_ONCE
            while at < len(targets.kid) and left > 0:
                t, p = filtered.near(np.arange(at, min(at + many, len(targets.kid))))
                at += many
                many = min(2 * many, _TARGETS) if len(t) < _AT_ONCE else 1
                kept = ~covered[p] & (probes.kid[p] > targets.kid[t])
                found.append((t[kept], p[kept]))
                left -= int(kept.sum())
            self._give(filtered, np.concatenate([t for t, _ in found]), np.concatenate([p for _, p in found]), covered, None)
            if covered.sum() * 2 > len(covered):  # what is covered is looked at no more
                probes = probes.take(~covered)
                if len(probes.kid):
                    covered, filtered = np.zeros(len(probes.kid), bool), _Filter(probes, targets, self.threshold)

    def one_by_one(self, side: _Side, targets: _Side) -> None:
        """The keys of a part in the order of their numbers: one that no leader covers leads itself.

        Some uncovered keys are looked at together, as long as few pairs come of it; those that
        one of them turns out to cover are passed over.
        """
        where = np.argsort(side.kid)  # of a target among the probes
        covered, filtered = np.zeros(len(side.kid), bool), _Filter(side, targets, self.threshold)
        at, many = 0, 1
        while at < len(targets.kid):
            some: list[np.ndarray] = []
            found: list[tuple[np.ndarray, np.ndarray]] = []
            left = _AT_ONCE
            while at < len(targets.kid) and left > 0:
                mine = np.arange(at, min(at + many, len(targets.kid)))
                at += many
                mine = mine[~covered[where[mine]]]
                if not len(mine):
                    continue
                t, p = filtered.near(mine)
                many = min(2 * many, _TARGETS) if len(t) < _AT_ONCE else 1
                kept = ~covered[p] & (side.kid[p] > targets.kid[t])
                some.append(mine), found.append((t[kept], p[kept]))
                left -= int(kept.sum())
            if some:
                self._give(filtered, np.concatenate([t for t, _ in found]), np.concatenate([p for _, p in found]), covered, where)
                for i in np.concatenate(some).tolist():
                    if not covered[where[i]]:
                        self.kids.append(int(targets.kid[i])), self.leaders.append(int(targets.kid[i]))


def _nearest_of(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side, targets = _sides(table)
        lead = _Leading(threshold)
        for probes in side.chunks():
            lead.nearest(probes, targets)
        return lead.table()

    return run


def _loop_of(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        lead = _Leading(threshold)
        lead.one_by_one(_Side(table, "n"), _Side(table, "kid"))
        return lead.table()

    return run


def _settle(table: pa.Table) -> pa.Table:
    """(kid, leader) of the keys that a leader covers, by all similar pairs among them."""
    kids, leaders = [], []
    covered: set[int] = set()
    told = table.sort_by([("hi", "ascending"), ("lo", "ascending")])
    for lo, hi in zip(told.column("lo").to_pylist(), told.column("hi").to_pylist(), strict=True):
        if hi not in covered and lo not in covered:
            covered.add(hi)
            kids.append(hi), leaders.append(lo)
    return pa.Table.from_arrays([pa.array(kids, pa.int64()), pa.array(leaders, pa.int64())], ["kid", "leader"])


_CELL = ("kid", "key", "n", "bits")


def _dealt(keys: DataFrame, parts: int, side: int, others: Column, cell: Callable[[Column, Column], Column], once: Column) -> DataFrame:
    part = F.pmod(F.xxhash64("kid"), F.lit(parts)).cast("int")
    rows = keys.withColumn("_part", part).select(*_CELL, F.lit(side).alias("_side"), once.alias("_once"), "_part", F.explode(others).alias("_other"))
    return rows.select(*_CELL, "_side", "_once", cell(F.col("_part"), F.col("_other")).alias("_cell"))


def _spread(rows: DataFrame, cells: int) -> DataFrame:
    """Every cell in a task of its own, as far as hashing goes: twice the partitions keep most cells from meeting."""
    return rows.repartition(max(2 * cells - 1, 1), "_cell")


def candidates(probes: DataFrame, targets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a probe and a target that pass every necessary condition.

    Both are profiles, targets some of the probes (``is_target`` on the probe) or none.  A pair of
    two targets comes out once: in the cell of the later part, or by number inside a part.
    """
    n = targets.count()
    parts = max(math.ceil(n / SALT_ROWS), min(math.isqrt(2 * CELLS), math.ceil(n / LEAST_TOLD)), 1)
    part, upto = F.col("_part"), F.lit(parts - 1)
    left = _dealt(
        probes, parts, 0, F.sequence(F.lit(0), F.when(F.col("is_target"), part).otherwise(upto)),
        lambda own, other: own * parts + other, F.col("is_target"),
    )
    right = _dealt(targets, parts, 1, F.sequence(F.lit(0), upto), lambda own, other: other * parts + own, F.lit(True))
    # in a cell of two parts no pair comes up twice; inside one part the number decides
    rows = left.unionByName(right).withColumn("_once", F.col("_once") & (F.floor(F.col("_cell") / parts) == F.col("_cell") % parts))
    return _spread(rows, parts * parts).groupBy("_cell").applyInArrow(
        _pairs_of(threshold), "lo long, hi long, later string, earlier string"
    )


def nearest(probes: DataFrame, targets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(kid, leader): the lowest-numbered target before it that a probe is similar to, for probes that have one."""
    many, few = probes.count(), targets.count()
    parts = max(math.ceil(many / SALT_ROWS), min(CELLS // 8, math.ceil(many / LEAST_ROWS)), 1)
    across = max(math.ceil(few / SALT_ROWS), min(math.ceil(CELLS / parts), math.ceil(few / LEAST_TARGETS)), 1)
    left = _dealt(probes, parts, 0, F.sequence(F.lit(0), F.lit(across - 1)), lambda own, other: own * across + other, F.lit(False))
    right = _dealt(targets, across, 1, F.sequence(F.lit(0), F.lit(parts - 1)), lambda own, other: other * across + own, F.lit(False))
    found = _spread(left.unionByName(right), parts * across).groupBy("_cell").applyInArrow(_nearest_of(threshold), "kid long, leader long")
    return found.groupBy("kid").agg(F.min("leader").alias("leader"))


def one_by_one(block: DataFrame, threshold: float = THRESHOLD, part: Column | None = None, parts: int = 1) -> DataFrame:
    """(kid, leader) of a block, of each part for itself, that fits a task: every key, a leader its own."""
    rows = _spread(block.select(*_CELL, (F.lit(0) if part is None else part).alias("_cell")), parts)
    return rows.groupBy("_cell").applyInArrow(_loop_of(threshold), "kid long, leader long")


def settled(pairs: DataFrame) -> DataFrame:
    """(kid, leader) of the covered keys, by all similar pairs (lo, hi) among keys; one task goes through the pairs."""
    rows = pairs.select("lo", "hi", F.lit(0).alias("_cell"))
    return rows.groupBy("_cell").applyInArrow(lambda table: _settle(table), "kid long, leader long")


def _ratio_at_least(threshold: float):
    @F.pandas_udf("boolean")  # not deterministic: else the filter would be taken below the spreading of its pairs
    def similar(later: pd.Series, earlier: pd.Series) -> pd.Series:
        matcher, known = SequenceMatcher(None), None

        def one(a: str, b: str) -> bool:
            nonlocal known
            if b != known:
                matcher.set_seq2(b)
                known = b
            matcher.set_seq1(a)
            return matcher.ratio() >= threshold

        return pd.Series([one(a, b) for a, b in zip(later, earlier, strict=True)], dtype=bool)

    return similar.asNondeterministic()


def similar_pairs(probes: DataFrame, targets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(lo, hi): verified pairs; the later key is the first argument of the ratio.

    Verifying costs far more than moving a pair, so pairs are spread evenly before it:
    by both ids, because one leader may be in a third of them.
    """
    found = candidates(probes, targets, threshold)
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = found.repartition(parts, "lo", "hi").sortWithinPartitions("lo")
    return spread.where(_ratio_at_least(threshold)(F.col("later"), F.col("earlier"))).select("lo", "hi")
