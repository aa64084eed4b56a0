"""Versioned snapshots, the run log, and the JSON documents at the edges.

A version is a new directory, complete once Spark wrote its ``_SUCCESS`` file; the one
being read is never overwritten.  Versions are bucketed and sorted by id: an upsert that is
told the number of buckets joins the stored side in place and shuffles the batch only.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.ids import place_id, posting_id
from gleanery.functions.text import text
from gleanery.operators.board import snapshot_order
from gleanery.operators.order import last_wins
from gleanery.schema import PLACE, POSTING, conform, places_for_export, places_with_nulls
from gleanery.session import file_system
from gleanery.settings import Run
from gleanery.sources.documents import read_items

RUN_LOG = "run_ts timestamp_ntz, source string, n long"
_VERSION = re.compile(r"version=(\d+)\.buckets=(\d+)")


class SnapshotTable:
    """``root/version=<n>.buckets=<b>``: each version names its own layout.

    ``buckets`` is for versions written from here on and should give files of some hundred
    megabytes; without it the layout of the last version is kept.
    """

    def __init__(
        self, spark: SparkSession, root: str, schema: T.StructType, key: str = "id", buckets: int | None = None
    ):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.key, self._buckets = key, buckets

    def _complete(self) -> dict[int, int]:
        """Buckets of every complete version."""
        fs, root = file_system(self.spark, self.root)
        found: dict[int, int] = {}
        if fs.exists(root):
            jvm = self.spark._jvm
            for status in fs.listStatus(root):
                match = _VERSION.fullmatch(status.getPath().getName())
                if match and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    found.setdefault(int(match[1]), int(match[2]))
        return found

    def versions(self) -> list[int]:
        return sorted(self._complete())

    def latest(self, below: int | None = None) -> int | None:
        found = [v for v in self.versions() if below is None or v < below]
        return found[-1] if found else None

    def buckets_of(self, version: int | None) -> int | None:
        """The layout a version was written with."""
        return self._complete().get(version)

    @property
    def buckets(self) -> int:
        """The layout of the next version."""
        found = self._buckets or self.buckets_of(self.latest())
        if not found:
            raise ValueError("the first version needs a number of buckets")
        return found

    def _path(self, version: int, buckets: int) -> str:
        return f"{self.root}/version={version:09d}.buckets={buckets}"

    def read(self, version: int | None = None) -> DataFrame:
        """A version (the last one) as a bucketed table; empty when there is none.

        The catalog is only asked for the layout: the table's files stay when its name is
        dropped again, and the plan already knows them.
        """
        version = self.latest() if version is None else version
        if version is None:
            return self.empty()
        buckets = self.buckets_of(version)
        if buckets is None:
            raise ValueError(f"there is no complete version {version}")
        name = f"snapshot_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({self.key}) "
            f"SORTED BY ({self.key}) INTO {buckets} BUCKETS LOCATION '{self._path(version, buckets)}'"
        )
        rows = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return rows

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def write(
        self, rows: DataFrame, version: int | None = None, clustered: int | None = None, again: bool = False
    ) -> int:
        """Write the next (or the named) version.  A complete version is left as it is,
        so a repeated run of one batch changes nothing; ``again`` writes it anew all the same.

        ``clustered`` is the number of buckets that the rows already lie in, bucket by
        bucket, because they come from a join with a stored version.  Rows that lie in
        none, or in another number than is wanted, are shuffled once.
        """
        if version is None:
            version = (self.latest() or 0) + 1
        if not again and version in self.versions():
            return version
        name, buckets = f"snapshot_{uuid.uuid4().hex}", self.buckets
        canonical = conform(rows, self.schema)
        (
            (canonical if clustered == buckets else canonical.repartition(buckets, self.key))
            .write.format("parquet")
            .mode("overwrite")
            .bucketBy(buckets, self.key)
            .sortBy(self.key)
            .option("path", self._path(version, buckets))
            .saveAsTable(name)
        )
        self.spark.sql(f"DROP TABLE {name}")  # external: the files stay
        return version


def log_run(counts: DataFrame, path: str, run: Run, version: int) -> None:
    """Log (run_ts, source, n) of the run that wrote a version, once however often it is repeated;
    the envelope of a snapshot is derived from it."""
    row = counts.select(
        F.lit(run.at).cast("timestamp_ntz").alias("run_ts"),
        F.col("name").alias("source"),
        F.col("n").cast("long").alias("n"),
    )
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version:09d}")


def envelope(log: DataFrame, rows: DataFrame) -> DataFrame:
    """One row about a snapshot: when it was last checked, how many rows each source gave
    then, and how many are stored.  The last run's sources are as many as are enabled; of two runs
    of one instant the later version counts."""
    at = F.col("version") if "version" in log.columns else F.lit(0)
    last = log.groupBy("run_ts", "source").agg(F.max_by("n", at).alias("n"))
    last = last.groupBy("run_ts").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    newest = last.agg(F.max("run_ts").alias("checked_at"), F.max_by("counts", "run_ts").alias("counts"))
    return newest.withColumn("count", rows.agg(F.count("*")).scalar())


def import_postings(spark: SparkSession, path: str, run: Run) -> DataFrame:
    """Rows of a ``{"jobs": […]}`` document or a bare array; the last duplicate wins.

    A document is read in ranges by many tasks, however large it is.  A broken document fails
    the read; it is never taken for an empty snapshot.
    """
    item = T.StructType([f for f in POSTING.fields if f.name != "posted_ts"])
    rows = _document(spark, path, item, "jobs")
    today = F.lit(run.day)
    filled = rows.withColumns(
        {
            **{
                c: text(F.col(c))
                for c in ("title", "company", "url", "source", "location", "remote_type", "description", "salary")
            },
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("new")),
            "score": F.coalesce("score", F.lit(0)),
            "first_seen": F.coalesce("first_seen", today),
            "id": F.coalesce(F.nullif("id", F.lit("")), posting_id(F.col("url"), F.col("title"), F.col("company"))),
        }
    )
    return last_wins(filled, ["id"], ["_at"]).drop("_at")


def import_places(spark: SparkSession, path: str, run: Run) -> DataFrame:
    rows = _document(spark, path, PLACE, "restaurants")
    today = F.lit(run.day)
    filled = rows.withColumns(
        {
            "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("new")),
            "first_seen": F.coalesce("first_seen", today),
            "last_updated": F.coalesce("last_updated", today),
            "id": F.coalesce(
                F.nullif("id", F.lit("")), place_id(F.col("source_id"), F.col("name"), F.col("address"))
            ),
        }
    )
    return places_with_nulls(last_wins(filled, ["id"], ["_at"]).drop("_at"))


def _document(spark: SparkSession, path: str, item: T.StructType, key: str) -> DataFrame:
    fs, target = file_system(spark, path)
    place = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("seq", T.LongType())])
    order = T.StructField("_at", place)
    if not fs.exists(target):
        return spark.createDataFrame([], T.StructType([*item.fields, order]))
    items, single = read_items(spark, path, key)
    parsed = F.from_json("text", item, {"mode": "FAILFAST"})
    rows = items.select(parsed.alias("_e"), F.struct("file", "start", "seq").alias("_at")).select("_e.*", "_at")
    if single:  # an object without the array is one row, or none
        alone = spark.read.schema(item).option("multiLine", True).option("mode", "FAILFAST").json(single)
        at = F.struct(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("seq"))
        rows = rows.unionByName(alone.select(*item.names, at.alias("_at")))
    return rows.where(F.coalesce(*[F.col(c).cast("string") for c in ("id", "source")]).isNotNull())


def export_postings(df: DataFrame, path: str) -> None:
    """JSON lines, newest and best first."""
    snapshot_order(conform(df, POSTING).drop("posted_ts"), "score").write.json(path)


def export_places(df: DataFrame, path: str) -> None:
    snapshot_order(places_for_export(df), "rating").write.json(path)
