"""Status per (space, id): the newest change wins, whatever order changes arrive in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import text

KEY = ("space", "id")


def _precedence(arrival: Column) -> Column:
    """Newest first; of equally new changes the one that arrived first stays."""
    return F.struct(F.coalesce("ts", F.lit(0)).alias("ts"), (-arrival).alias("arrival"))


def latest_state(changes: DataFrame, arrival: str = "arrival") -> DataFrame:
    """(space, id, status, ts, arrival); combines map-side, so hot spaces do not skew."""
    value = F.struct(
        text(F.col("status")).alias("status"),
        F.coalesce("ts", F.lit(0)).alias("ts"),
        F.col(arrival).alias("arrival"),
    )
    newest = changes.groupBy(*KEY).agg(F.max_by(value, _precedence(F.col(arrival))).alias("_v"))
    return newest.select(*KEY, "_v.*")


def merge_state(stored: DataFrame, changes: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Stored states count as having arrived before every change."""
    before = stored.select(*KEY, "status", "ts", F.lit(-1).cast("long").alias("arrival"))
    incoming = changes.select(*KEY, "status", "ts", F.col(arrival).cast("long").alias("arrival"))
    return latest_state(before.unionByName(incoming)).drop("arrival")


def with_status(rows: DataFrame, states: DataFrame, default: str = "new") -> DataFrame:
    """Rows with the user's status; rows nobody touched are ``new``."""
    own = states.select("id", F.col("status").alias("_status"))
    return (
        rows.drop("status")
        .join(own, "id", "left")
        .withColumn("status", F.coalesce(F.nullif("_status", F.lit("")), F.lit(default)))
        .drop("_status")
    )
