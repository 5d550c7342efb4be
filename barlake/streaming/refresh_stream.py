"""Incremental refresh over arriving bar files.

A micro-batch becomes a delta: files with its bars only, which readers merge by key with what they overlap. So a batch
writes in proportion to itself, whatever the size of its years. The commit that adds the delta also records the
stream and the number of the batch; a batch that is delivered again is refused before anything is written.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from barlake.operators.bars import duplicates_removed, fold_raw, folded_bars
from barlake.operators.coverage import refresh_coverage, refreshed_of_ranges
from barlake.operators.layers import touched
from barlake.operators.partials import ranges_of, updated
from barlake.operators.presence import merged, presence
from barlake.operators.reports import manifest_statistics, per_year
from barlake.plans.refresh import with_carried_years
from barlake.schema import BAR_COLUMNS, BAR_KEY, BAR_SCHEMA
from barlake.session import cut
from barlake.sinks.snapshots import BarStore


def bar_stream(spark: SparkSession, path: str, schema: StructType = BAR_SCHEMA, **options: str) -> DataFrame:
    """Bar files as they arrive."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def split_late(batch: DataFrame, refresh_start) -> tuple[DataFrame, DataFrame]:
    """(on time, late): bars older than the refresh start are not merged."""
    late = F.coalesce(F.col("date") < F.lit(refresh_start), F.lit(False))
    return batch.where(~late), batch.where(late)


def apply_batch(store: BarStore, batch: DataFrame, batch_id: int, refresh_start: dt.date, end: dt.date, run: str = "batches") -> bool:
    """Merge one micro-batch: quarantine late, unexpected, invalid and conflicting bars, upsert the rest, commit.

    `run` names the stream in the log and in the quarantine, so that streams with checkpoints of their own do not
    get in each other's way. Where the store has coverage and a manifest, they follow the bars, and
    tickers without coverage are unexpected. False if the batch, or a later one, was committed before.
    """
    store = store.at()
    applied = store.applied(run)
    if applied is not None and batch_id <= applied:
        return False
    held = store.tables()
    label = f"run={run}/batch={batch_id:012d}"
    arrived = cut(batch)
    on_time, late = split_late(arrived, refresh_start)
    late.write.mode("overwrite").parquet(f"{store.root}/quarantine/late/{label}")
    if "coverage" in held:
        known = store.table("coverage").select("ticker")
        on_time.join(known, "ticker", "left_anti").write.mode("overwrite").parquet(f"{store.root}/quarantine/unexpected/{label}")
        on_time = on_time.join(known, "ticker", "left_semi").select(*batch.columns)
    folded = cut(fold_raw(on_time, refresh_start, end))
    refused = folded.where("conflict OR invalid > 0").select("date", "ticker", "copies", "invalid", "conflict")
    refused.write.mode("overwrite").parquet(f"{store.root}/quarantine/refused/{label}")
    new = folded_bars(folded)
    arriving = {r.year: r for r in per_year(new).collect()}  # calendar years
    if not arriving:
        return True
    # named by the version as well: a replay must not overwrite files that a commit serves
    snapshot = f"stream-{run}-{batch_id:012d}-{store.version() + 1}"
    store.stage(snapshot, new)
    before = store.current().where(F.col("year").isin(list(arriving))).select("year", "row_count", "deltas").collect()
    files = store.files(list(arriving))
    first, last = min(r.min_date for r in arriving.values()), max(r.max_date for r in arriving.values())
    # the keys that the batch replaces, looked for in the files that may hold its days
    replaced = cut(store.bars_in(touched(files, first, last).hit).join(new.select(*BAR_KEY), BAR_KEY, "left_semi"))
    gone = {r.year: r.row_count for r in per_year(replaced).collect()}
    held_rows = {r.year: r.row_count for r in before}
    counts = {y: held_rows.get(y, 0) + r.row_count - gone.get(y, 0) for y, r in arriving.items()}
    layer = 1 + max((f.layer for f in files), default=0)
    listed = store.stage_files(snapshot, files, layer=layer)
    deltas = {y: len({f.layer for f in listed if f.year == y and f.layer}) for y in arriving}
    tables = {}
    if "coverage" in held:
        prior = store.table("coverage")
        none = F.lit(0).cast("bigint").alias("attempt_count")
        state = prior.select("ticker", "status", none, F.col("last_error").alias("error_message"))
        if "partials" in held:
            tables["partials"] = cut(updated(store.table("partials"), replaced, new))
            tables["coverage"] = cut(refreshed_of_ranges(known, prior, ranges_of(tables["partials"]), state))
        else:
            tables["coverage"] = cut(refresh_coverage(known, prior, replaced, new, state))
    if "coverage" in held and "manifest" in held:
        was = store.table("manifest").first()
        rows = folded.agg(F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid")).first()
        bounds = {y: [f for f in listed if f.year == y] for y in arriving}
        changed = store.spark.createDataFrame(
            [(y, n, min(f.min_date for f in bounds[y]), max(f.max_date for f in bounds[y])) for y, n in counts.items()],
            "year int, row_count long, min_date date, max_date date",
        )
        tables["manifest"] = manifest_statistics(
            with_carried_years(store, changed, sorted(counts), tables["coverage"]), tables["coverage"],
            universe_sha256=was.universe_sha256, universe_count=was.universe_ticker_count,
            start=dt.date.fromisoformat(was.requested_start), end=max(end, dt.date.fromisoformat(was.requested_end_exclusive)),
            invalid_rows=rows.invalid, duplicate_rows=duplicates_removed(folded).first().duplicate_rows,
        )
    if "presence" in held:
        tables["presence"] = merged(store.table("presence"), presence(new))
    for name, table in tables.items():
        store.stage_table(snapshot, name, table)
    store.commit(snapshot, counts, list(tables), deltas=deltas, stream=(run, batch_id))
    return True


def refresh_stream(
    bars: DataFrame,
    store: BarStore,
    checkpoint: str,
    *,
    refresh_start: dt.date,
    end: dt.date,
) -> StreamingQuery:
    """Run everything available and stop. bars has the raw bar columns.

    The checkpoint names the stream: restarted with it, the stream goes on under the same name.
    """
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    return (
        bars.select(*BAR_COLUMNS)
        .writeStream.foreachBatch(lambda batch, i: apply_batch(store, batch, i, refresh_start, end, run))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
