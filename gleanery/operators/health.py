"""Run bookkeeping: rows per source, silent sources, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ranked_names(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(name, rank) of the enabled list: configuration, a local relation."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, rank int")


def rows_per_source(rows: DataFrame, by: str = "source") -> DataFrame:
    return rows.groupBy(F.col(by).alias("source")).agg(F.count("*").alias("n"))


def source_counts(enabled: DataFrame, counts: DataFrame) -> DataFrame:
    """Every enabled source with its row count, 0 when it returned nothing."""
    return enabled.join(counts, enabled["name"] == counts["source"], "left").select(
        "name", "rank", F.coalesce("n", F.lit(0)).alias("n")
    )


def silent_sources(enabled: DataFrame, counts: DataFrame) -> DataFrame:
    return source_counts(enabled, counts).where(F.col("n") == 0)


def contributing_sources(enabled: DataFrame, counts: DataFrame) -> DataFrame:
    return source_counts(enabled, counts).where(F.col("n") > 0).select("name", "rank")


def known_sources(enabled: DataFrame, registry: DataFrame) -> DataFrame:
    return enabled.join(registry.select("name"), "name", "left_semi")


def unknown_sources(enabled: DataFrame, registry: DataFrame) -> DataFrame:
    return enabled.join(registry.select("name"), "name", "left_anti")


def run_totals(merged: DataFrame) -> DataFrame:
    """One row (stored, new) of an upsert result."""
    return merged.agg(F.count("*").alias("stored"), F.count(F.when(F.col("is_new"), 1)).alias("new"))
