"""Whole-word needles and the text they are looked up in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import quoted, text

WORD = r"[\p{L}\p{N}_]"


def _starts(needles: Sequence[str]) -> str:
    """A look-ahead on the first characters: most positions are left after one table
    lookup, before the costlier look-behind."""
    if not all(needles):
        return ""
    return "(?=[" + "".join(f"\\x{{{c:x}}}" for c in sorted({ord(n[0]) for n in needles})) + "])"


def contains_word(lowered: Column, needles: Sequence[str]) -> Column:
    """Any needle as a whole word; one alternation, so the text is scanned once."""
    if not needles:
        return F.lit(False)
    low = [n.lower() for n in needles]
    any_of = "|".join(map(quoted, low))
    return text(lowered).rlike(f"{_starts(low)}(?<!{WORD})(?:{any_of})(?!{WORD})")


def contains_text(lowered: Column, needles: Sequence[str]) -> Column:
    """Any needle anywhere, also inside a word."""
    if not needles:
        return F.lit(False)
    low = [n.lower() for n in needles]
    return text(lowered).rlike(_starts(low) + "(?:" + "|".join(map(quoted, low)) + ")")


def haystack(*parts: Column) -> Column:
    """Lower-cased search text; an unknown part still leaves its separator."""
    joined: list[Column] = []
    for part in parts:
        joined += [F.lit(" "), text(part)]
    return F.lower(F.concat(*joined[1:]))


def joined(words: Column) -> Column:
    return text(F.array_join(words, " "))
