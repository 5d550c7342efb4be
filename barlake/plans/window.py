"""upsert_window: new bars into the files they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators.layers import FILE_SCHEMA, year_facts
from barlake.operators.reports import per_year
from barlake.operators.upsert import upsert
from barlake.plans.backfill import new_snapshot_id
from barlake.session import cut
from barlake.sinks.snapshots import BarStore


def upsert_window(store: BarStore, new: DataFrame) -> str | None:
    """Merge canonical bars, unique by key, into the store; only files whose zone maps reach into their days are opened.

    Files that cannot hold one of these days keep their names and are in the new version as they are. Returns the
    snapshot, or None if there is nothing to merge.
    """
    store = store.at()
    new = cut(new)
    arriving = per_year(new).collect()  # calendar years
    if not arriving:
        return None
    snapshot = new_snapshot_id("upsert")
    split = store.window(min(r.min_date for r in arriving), max(r.max_date for r in arriving), [r.year for r in arriving])
    store.stage(snapshot, upsert(store.bars_in(split.hit), new))
    listed = store.stage_files(snapshot, split.kept)
    facts = year_facts(store.spark.createDataFrame([tuple(f) for f in listed], FILE_SCHEMA)).collect()
    deltas = {r.year: len({f.layer for f in split.kept if f.year == r.year and f.layer}) for r in facts}
    store.commit(snapshot, {r.year: r.row_count for r in facts}, deltas=deltas)
    return snapshot
