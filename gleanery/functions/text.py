"""String cleaning with the blank and cut rules the readers share."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)

MISSING = "—"


def text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(BLANKS))


def or_default(column: Column, default: str | Column) -> Column:
    """``column`` unless it is null or empty."""
    other = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(column, F.lit("")), other)


def collapse_blanks(column: Column) -> Column:
    """Every run of blanks to one space.  Other blanks become spaces first, so that the
    pattern starts with a plain character and only runs of several are replaced."""
    others = BLANKS.replace(" ", "")
    spaced = F.translate(column, others, " " * len(others))
    return strip(F.regexp_replace(spaced, " {2,}", " "))


def strip_tags(column: Column) -> Column:
    return F.regexp_replace(column, "<[^>]+>", " ")


def cut(column: Column, length: int | None) -> Column:
    """The first characters; ``None`` leaves the text whole.  Readers store whole texts."""
    return column if length is None else F.substring(column, 1, length)


def plain_description(column: Column, length: int | None = None) -> Column:
    """Tags out, then cut, then strip: what most readers store."""
    return strip(cut(strip_tags(text(column)), length))


def decoded_description(column: Column, length: int | None = None) -> Column:
    """Tags out, entities decoded, strip, then cut."""
    return cut(strip(F.replace(decode_entities(strip_tags(text(column))), F.lit("\xa0"), F.lit(" "))), length)


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def decode_entities(column: Column) -> Column:
    """Only texts with an ampersand travel to Python."""
    return F.coalesce(_unescape(F.when(F.contains(column, F.lit("&")), column)), column)


class _Folded(dict):
    """Character code to its compatibility decomposition without combining marks.

    Marks go, so their canonical order does not matter and characters fold one by one.
    """

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(code))
        self[code] = folded = "".join(c for c in parts if not unicodedata.combining(c))
        return folded


@F.pandas_udf(T.StringType())
def _without_marks(values: pd.Series) -> pd.Series:
    folded = _Folded()
    return values.map(lambda v: v.translate(folded), na_action="ignore")


def match_key(column: Column) -> Column:
    """Compatibility-decomposed, without accents, lower case, single blanks.

    ASCII text is its own decomposition, so only the rest travels to Python.
    """
    plain = column.rlike(r"^\p{ASCII}*\z")
    return collapse_blanks(F.lower(F.coalesce(_without_marks(F.when(~plain, column)), column)))


def title_case(column: Column) -> Column:
    """Upper-case the first letter of every run of letters (also after ``-`` or ``'``)."""
    runs = F.regexp_extract_all(column, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))
        ),
        "",
    )


def escape_markup(column: Column) -> Column:
    # Fixed values, in this order.
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        column = F.replace(column, F.lit(plain), F.lit(coded))
    return column


def quoted(needle: str) -> str:
    """A literal inside a Java regular expression."""
    return "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
