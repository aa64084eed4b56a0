"""Versions of postings as a base snapshot and the folded batches since.

A run appends its batch, folded to one row per posting, and leaves the base alone: what it
writes grows with the batch.  Once the batches since the last base have passed ``fold_ratio``
of its size, or ``most_deltas`` in number, the next run writes a new base instead, so each
stored byte is rewritten once per ``fold_ratio`` of growth.  A reader merges: the base is a
bucketed table that is joined in place, only the batches are shuffled.

The result is that of rewriting everything on every run, removals included: a posting that was
past its time at the end of a run is gone, and if it comes in again it is a new one.  The day of
each run is part of the name of what it wrote, so a reader can tell.

Rows carry their base score and the key of the preferences it was made with; the names of base
and batches tell the keys, so a reader knows whether any text has to be looked into.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.scoring import preference_key, score_base, score_stored
from gleanery.operators.retention import PROTECTED, RETENTION_DAYS, is_retained
from gleanery.operators.upsert import side_by_side
from gleanery.plans.snapshot import SnapshotTable
from gleanery.schema import POSTING, conform
from gleanery.session import file_system
from gleanery.settings import Preferences, Run

STORED = T.StructType([*POSTING.fields, T.StructField("base_score", T.IntegerType()), T.StructField("scored_by", T.StringType())])
_PLAIN = [c for c in STORED.names if c not in ("id", "first_seen", "status")]
_NAME = re.compile(r"(base|delta)=(\d+)\.day=(\d{4}-\d{2}-\d{2})\.scored=(\w+)")


@dataclass(frozen=True)
class Part:
    """One complete directory: what a run wrote, on which day, and scored with which preferences."""

    kind: str
    version: int
    day: date
    scored: str
    path: str
    size: int


def _past_its_time(row: Column, day: Column) -> Column:
    """Whether a row, as it stood, was removed at the end of a run on ``day`` (null: nothing is removed)."""
    stays = (row["first_seen"] >= F.date_sub(day, RETENTION_DAYS)) | row["status"].isin(*PROTECTED)
    return day.isNotNull() & ~F.coalesce(stays, F.lit(False))


class DeltaSnapshots:
    """``root/base=<n>.day=<d>.scored=<k>/`` and ``root/delta=<n>.day=<d>.scored=<k>``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int, fold_ratio: float = 0.25, most_deltas: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.fold_ratio, self.most_deltas = fold_ratio, most_deltas

    def _parts(self) -> list[Part]:
        fs, root = file_system(self.spark, self.root)
        found = []
        if fs.exists(root):
            for status in fs.listStatus(root):
                path = status.getPath()
                match = _NAME.fullmatch(path.getName())
                if not match:
                    continue
                if match[1] == "base":
                    done = self._base(path.toString()).latest() is not None
                else:
                    done = fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))
                if done:
                    size = fs.getContentSummary(path).getLength()
                    found.append(Part(match[1], int(match[2]), date.fromisoformat(match[3]), match[4], path.toString(), size))
        # of a base and a batch of one run the base counts
        return sorted(found, key=lambda p: (p.version, p.kind == "base"))

    def _base(self, path: str) -> SnapshotTable:
        return SnapshotTable(self.spark, path, STORED, buckets=self.buckets)

    def _read_base(self, base: Part | None) -> tuple[DataFrame, int | None]:
        """Rows of a base, and the number of buckets they lie in."""
        if base is None:
            return self.spark.createDataFrame([], STORED), None
        table = self._base(base.path)
        return table.read(), table.buckets_of(table.latest())

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], STORED)

    def versions(self) -> list[int]:
        return sorted({p.version for p in self._parts()})

    def latest(self, below: int | None = None) -> int | None:
        found = [v for v in self.versions() if below is None or v < below]
        return found[-1] if found else None

    def chain(self, version: int | None) -> tuple[Part | None, list[Part]]:
        """The base that a version starts from, and the batches since."""
        parts = [p for p in self._parts() if version is not None and p.version <= version]
        base = next((p for p in reversed(parts) if p.kind == "base"), None)
        return base, [p for p in parts if p.kind == "delta" and (base is None or p.version > base.version)]

    def merged(self, version: int | None) -> DataFrame:
        """Rows of a version before and after its removals: STORED, ``here`` (when its run merged it), ``stays``."""
        base, deltas = self.chain(version)
        stored, layout = self._read_base(base)
        if not deltas:
            return stored.withColumns({"here": F.lit(True), "stays": F.lit(True)})
        folded = self._folded(deltas)
        both, came, was = side_by_side(stored, folded, layout)
        steps = F.coalesce(F.col("b.steps"), F.array().cast("array<struct<version:int,before:date,first_seen:date,status:string>>"))
        start = F.struct(F.col("s.first_seen").alias("first_seen"), F.col("s.status").alias("status"), was.alias("here"))

        def step(row: Column, coming: Column) -> Column:
            status = F.coalesce(F.when(row["status"] != "new", row["status"]), coming["status"], row["status"])
            stayed = F.struct(row["first_seen"].alias("first_seen"), status.alias("status"), F.lit(True).alias("here"))
            anew = F.struct(coming["first_seen"].alias("first_seen"), coming["status"].alias("status"), F.lit(True).alias("here"))
            return F.when(row["here"] & ~_past_its_time(row, coming["before"]), stayed).otherwise(anew)

        rows = both.select(
            "id",
            *[F.when(came, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in _PLAIN],
            F.aggregate(steps, start, step).alias("now"),
            F.coalesce(F.try_element_at(steps, F.lit(-1))["version"] == deltas[-1].version, F.lit(False)).alias("last"),
        ).select("id", *_PLAIN, "now.first_seen", "now.status", "last")
        before = deltas[-2].day if len(deltas) > 1 else None  # a base holds no row that was past its time
        here = F.col("last") | (F.lit(True) if before is None else F.coalesce(is_retained(before), F.lit(False)))
        stays = here & F.coalesce(is_retained(deltas[-1].day), F.lit(False))
        return rows.select(*STORED.names, here.alias("here"), stays.alias("stays"))

    def _folded(self, deltas: list[Part]) -> DataFrame:
        """One row per posting of the batches: its last fields, and its steps, one per batch at most."""
        rows = None
        for i, part in enumerate(deltas):
            before = F.lit(deltas[i - 1].day if i else None).cast("date")
            own = self.spark.read.schema(STORED).parquet(part.path).withColumns({"version": F.lit(part.version), "before": before})
            rows = own if rows is None else rows.unionByName(own)
        return rows.groupBy("id").agg(
            F.max_by(F.struct(*_PLAIN), "version").alias("last"),
            F.array_sort(F.collect_list(F.struct("version", "before", "first_seen", "status"))).alias("steps"),
        ).select("id", "last.*", "steps")

    def read_stored(self, version: int | None = None) -> DataFrame:
        """Rows of a version (the last one) as stored, with their base scores."""
        version = self.latest() if version is None else version
        return self.merged(version).where("stays").select(*STORED.names)

    def read(self, prefs: Preferences, run: Run, version: int | None = None) -> DataFrame:
        """Rows of a version with today's scores."""
        version = self.latest() if version is None else version
        base, deltas = self.chain(version)
        keys = {p.scored for p in [*([base] if base else []), *deltas]}
        return conform(score_stored(self.read_stored(version), prefs, run, keys <= {preference_key(prefs)}), POSTING)

    def write(self, folded: DataFrame, prefs: Preferences, run: Run, version: int | None = None) -> tuple[int, dict[str, int]]:
        """Take in a folded batch; the version, and how many rows there were ``before`` removal and were ``removed``.

        A complete version is left as it is, so a repeated run changes nothing.
        """
        version = (self.latest() or 0) + 1 if version is None else version
        name = f"{version:09d}.day={run.day}.scored={preference_key(prefs)}"
        if version not in self.versions():
            conform(score_base(folded, prefs), STORED).write.mode("overwrite").parquet(f"{self.root}/delta={name}")
            if self._full(version):
                whole, layout = score_stored(self.read_stored(version), prefs, run), self._read_base(self.chain(version)[0])[1]
                self._base(f"{self.root}/base={name}").write(whole, 1, clustered=layout)
        return version, self._totals(version)

    def _full(self, version: int) -> bool:
        base, deltas = self.chain(version)
        return base is None or len(deltas) >= self.most_deltas or sum(p.size for p in deltas) > self.fold_ratio * base.size

    def _totals(self, version: int) -> dict[str, int]:
        """From ids, days and statuses alone, as things stood before the version's base was written."""
        counted = _Before(self, version).merged(version)
        row = counted.agg(F.count_if("here").alias("before"), F.count_if("stays").alias("stored")).first()
        return {"before": row["before"], "removed": row["before"] - row["stored"]}


class _Before(DeltaSnapshots):
    """A store as it was before the base of one version was written; its batch is still there."""

    def __init__(self, store: DeltaSnapshots, version: int):
        super().__init__(store.spark, store.root, store.buckets, store.fold_ratio, store.most_deltas)
        self._version = version

    def _parts(self) -> list[Part]:
        return [p for p in super()._parts() if (p.kind, p.version) != ("base", self._version)]
