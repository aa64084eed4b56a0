"""First-wins and last-wins per key.

Spark prunes ``row_number() = 1`` before the shuffle (a window group limit per map
task), so a key that holds a third of all rows sends one row per task, not all.  That
limit sorts a map task's rows: wide rows that a small split unfolds into go by
``first_wins_wide``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(df: DataFrame, keys: Iterable[str], order: list[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") == 1).drop("_n")


def first_wins(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    return _first(df, keys, [F.col(c).asc() for c in order])


def last_wins(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    return _first(df, keys, [F.col(c).desc() for c in order])


def first_wins_wide(df: DataFrame, keys: Iterable[str], order: Iterable[str], by: str, shares: int = 16) -> DataFrame:
    """``first_wins`` that sorts no row before a shuffle, so what a task sorts does not grow with its split.

    A key's rows are dealt to ``shares`` tasks by their order and limited there, so a hot key still sends some
    rows only. What is left lies by the key ``by``, sorted by it, and may be joined on it without a shuffle.
    """
    keys, order = [by, *(k for k in keys if k != by)], list(order)
    dealt = df.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(shares)).cast("int"))
    few = first_wins(dealt.repartition(*keys, "_share"), [*keys, "_share"], order).drop("_share")
    return first_wins(few.repartition(by), keys, order)
