"""A postings run: feeds to snapshot to report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scoring import score
from gleanery.operators.health import ranked_names, rows_per_source, source_counts
from gleanery.operators.report import report_page, top_new
from gleanery.operators.retention import retain_counted, retention_totals
from gleanery.operators.state import with_status
from gleanery.operators.upsert import fold_postings, merge_folded_postings, new_rows
from gleanery.plans.deltas import DeltaSnapshots
from gleanery.plans.snapshot import SnapshotTable, log_run
from gleanery.schema import ORDER_COLUMNS, POSTING
from gleanery.session import Scratch
from gleanery.settings import Preferences, Run
from gleanery.sources.registry import MAILED, Inputs, known_names, read_enabled


@dataclass
class PostingsRun:
    version: int
    counts: DataFrame  # (name, rank, n) of every enabled source somebody can read
    unknown: list[str]  # enabled names nobody can read
    mails: DataFrame  # (uid) of the messages that gave a posting
    new: DataFrame  # rows that came in for the first time, scored
    report: DataFrame  # (subject, html)
    stored: int
    removed: int


def next_snapshot(
    stored: DataFrame,
    folded: DataFrame,
    prefs: Preferences,
    run: Run,
    states: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Merge a folded batch, then score every row: ages change every day.

    ``states`` (off by default) lets statuses set by users protect rows.
    """
    merged = merge_folded_postings(stored, folded, buckets)
    if states is not None:
        merged = with_status(merged, states)
    return score(merged.drop("score"), prefs, run)


def _rewritten(
    snapshots: SnapshotTable, before: int | None, scored: DataFrame, run: Run, version: int | None
) -> tuple[int, dict[str, int]]:
    """Write all rows that stay as the next version; a repeated run writes nothing."""
    if version is not None and version in snapshots.versions():
        return version, retention_totals(scored, run.day)
    kept, seen = retain_counted(scored, run.day)
    return snapshots.write(kept, version, clustered=snapshots.buckets_of(before)), seen.get


def postings_run(
    snapshots: SnapshotTable | DeltaSnapshots,
    inputs: Inputs | DataFrame,
    prefs: Preferences,
    run: Run,
    scratch: Scratch,
    states: DataFrame | None = None,
    log_path: str | None = None,
    report_path: str | None = None,
    processed_path: str | None = None,
    board_url: str = "",
    version: int | None = None,
) -> PostingsRun:
    """Read, fold, upsert, score, retain, write, report.

    With ``DeltaSnapshots`` a run appends its batch; with a ``SnapshotTable`` it rewrites all rows.
    ``inputs`` may be the landing rows alone.  The counts go to ``log_path``, the page to
    ``report_path``, and what stands for marking mails as read to ``processed_path``.  The stored version is read in full once, for the merge, and its id column once more,
    to tell new rows; only the folded batch is shuffled and written aside.
    """
    inputs = inputs if isinstance(inputs, Inputs) else Inputs(inputs)
    known = known_names(prefs.sources)
    unknown = [n for n in prefs.sources if n not in known]
    incoming = scratch.save(read_enabled(prefs.sources, inputs, run), "incoming")
    enabled = ranked_names(inputs.raw.sparkSession, known)
    counts = scratch.save(source_counts(enabled, rows_per_source(incoming, "reader")), "counts")
    mails = incoming.where(F.col("reader") == MAILED).select(F.col("seq").alias("uid")).distinct()
    by_delta = isinstance(snapshots, DeltaSnapshots)
    if by_delta and states is not None:
        raise ValueError("a store of batches takes no user states; join them on reading")

    folded = scratch.save(fold_postings(incoming), "folded")
    before = snapshots.latest(version)
    stored = snapshots.empty()
    if before is not None:
        stored = snapshots.read_stored(before) if by_delta else snapshots.read(before)
    new = scratch.save(score(new_rows(folded, stored).drop("score"), prefs, run), "new")
    new = new.select(*POSTING.names, *ORDER_COLUMNS)

    if by_delta:
        written, totals = snapshots.write(folded, prefs, run, version)
    else:
        written, totals = _rewritten(snapshots, before, next_snapshot(stored, folded, prefs, run, states, snapshots.buckets_of(before)), run, version)
    if log_path:  # after the rows: a run that fails before is not logged, one that is repeated is logged once
        log_run(counts, log_path, run, written)
    left = totals["before"] - totals["removed"]
    top = scratch.save(top_new(new, prefs, run), "top")
    page = report_page(top, left, counts.where(F.col("n") > 0), board_url, run)
    if report_path:
        page.coalesce(1).write.mode("overwrite").json(f"{report_path}/version={written:09d}")
    if processed_path:  # last: a run that fails before takes its mails again
        mails.write.mode("overwrite").parquet(f"{processed_path}/version={written:09d}")
    return PostingsRun(written, counts, unknown, mails, new, page, left, totals["removed"])
