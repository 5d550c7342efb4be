"""compact: fold the deltas of a store into its base files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from barlake.operators.layers import layered
from barlake.plans.backfill import new_snapshot_id
from barlake.sinks.snapshots import BarStore


@dataclass(frozen=True)
class Compacted:
    years: list[int]
    snapshot: str | None = None
    files_before: int = 0
    files_after: int = 0


def compact(store: BarStore, *, least_deltas: int = 1) -> Compacted:
    """Merge the deltas of every year that has at least so many of them with the files they overlap.

    Other files stay as they are, under their names. What readers see does not change, so row counts and tables carry
    over; a batch that a stream commits to such a year meanwhile makes the commit fail, and the job is run again.
    """
    store = store.at()
    due = store.current().where(F.coalesce("deltas", F.lit(0)) >= least_deltas).select("year", "row_count").collect()  # years
    if not due or least_deltas < 1:
        return Compacted([])
    years = sorted(r.year for r in due)
    files = store.files(years)
    split = layered(files)
    snapshot = new_snapshot_id("compact")
    store.stage(snapshot, store.bars_in(split.hit))
    after = store.stage_files(snapshot, split.kept)
    store.commit(snapshot, {r.year: r.row_count for r in due}, deltas=dict.fromkeys(years, 0))
    return Compacted(years, snapshot, len(files), len(after))
