"""refresh: upsert a rolling window into the affected years and commit."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.errors import DataQualityError, IdentityError, RefreshError
from barlake.functions.fingerprint import universe_identity
from barlake.operators.calendar import previous_sessions
from barlake.operators.coverage import (
    missing_at_target,
    missing_report,
    refresh_coverage,
    refreshed_of_ranges,
    resolve_status,
    target_coverage,
)
from barlake.operators.gates import counted, enforce, gather, sampled
from barlake.operators.layers import FILE_SCHEMA, Split, touched, year_facts
from barlake.operators.partials import ranges_of, updated
from barlake.operators.presence import active_on, day_bits, presence
from barlake.operators.presence import merged as merged_presence
from barlake.operators.quality import coverage_gate, stored_rules, stored_violations
from barlake.operators.reports import manifest_statistics, update_report, with_last_update
from barlake.operators.upsert import upsert, upsert_violations
from barlake.plans.backfill import new_snapshot_id
from barlake.plans.clean import clean_bars
from barlake.schema import ACTIVE_SESSIONS, MINIMUM_TARGET_COVERAGE, REFRESH_DAYS
from barlake.session import cut
from barlake.sinks.bars import observed_violations
from barlake.sinks.snapshots import BarStore
from barlake.sources.files import key_runs, stored_codecs


@dataclass(frozen=True)
class Refreshed:
    status: str
    target: dt.date
    refresh_start: dt.date
    years: list[int]
    snapshot: str | None = None
    coverage_ratio: float | None = None


def window_start(dataset_start: dt.date, target: dt.date, days: int = REFRESH_DAYS) -> dt.date:
    """Driver-side twin of functions.dates.refresh_start for one run."""
    if days < 0:
        raise ValueError("refresh days cannot be negative")
    if dataset_start > target:
        raise RefreshError(f"dataset start {dataset_start} is after target {target}")
    return max(dataset_start, target - dt.timedelta(days=days))


def with_carried_years(store: BarStore, changed: DataFrame, years: list[int], coverage: DataFrame) -> DataFrame:
    """The changed years' statistics and those of all other years, which are not read.

    Their counts are in the commit, and the earliest date of the dataset is the earliest of the coverage.
    """
    first_day = coverage.agg(F.min("first_date").alias("d")).first().d
    carried = store.current().where(F.col("year").isNotNull() & ~F.col("year").isin(years)).select(
        "year", "row_count", F.lit(first_day).cast("date").alias("min_date"), F.lit(None).cast("date").alias("max_date")
    )
    return changed.unionByName(carried)


def last_days(sessions: DataFrame, target: dt.date) -> list[dt.date]:
    """The sessions by which a ticker counts as active, a list of fixed size."""
    return [r.session for r in previous_sessions(sessions, target, ACTIVE_SESSIONS).select("session").collect()]


def kept_presence(store: BarStore, split: Split, sessions: DataFrame, target: dt.date) -> DataFrame:
    """The store's presence bitmaps; a store without them has its recent bars read instead."""
    if "presence" in store.tables():
        return store.table("presence")
    first = min(last_days(sessions, target), default=target)
    return presence(store.bars_in(touched([*split.hit, *split.kept], first, dt.date.max).hit))


def refresh(
    store: BarStore,
    universe: DataFrame,
    raw: DataFrame,
    attempts: DataFrame,
    sessions: DataFrame,
    target: dt.date,
    *,
    window_days: int = REFRESH_DAYS,
    minimum_coverage: float = MINIMUM_TARGET_COVERAGE,
    allow_partial: bool = False,
    dry_run: bool = False,
) -> Refreshed:
    """Recompute the window up to `target` (operators.calendar.target_session).

    Opens and rewrites only the files of the affected years whose zone maps reach into the window; the others stay
    as they are. A year without a partition counts as
    empty, so the first session of a new year works; an affected year that ends up empty fails.
    """
    store = store.at()
    manifest = store.table("manifest").first()
    identity = universe_identity(universe).first()
    if (manifest.universe_sha256, manifest.universe_ticker_count) != (identity.sha, identity.n):
        raise IdentityError("the dataset was built from a different universe")
    dataset_start = dt.date.fromisoformat(manifest.requested_start)
    latest = dt.date.fromisoformat(manifest.actual_max_date)
    start = window_start(dataset_start, target, window_days)
    years = list(range(start.year, target.year + 1))
    if target <= latest:
        return Refreshed("no_op", target, start, [])
    if dry_run:
        return Refreshed("dry_run", target, start, years)

    run = new_snapshot_id("refresh")
    end = target + dt.timedelta(days=1)
    split = store.window(start, dt.date.max, years)
    old = store.bars_in(split.hit)
    cleaned = clean_bars(raw, start, end, universe, materialize=True)
    cleaned.enforce()
    state = cut(resolve_status(attempts, universe, cleaned.partials(), cleaned.outcomes))
    failed = state.where("status = 'failed'")
    try:
        enforce(sampled(failed, "unresolved_failures", F.col("ticker")), RefreshError)
    except RefreshError:
        store.save_diagnostics(run, "download_failures", failed)
        raise
    enforce(upsert_violations(old, cleaned.bars, start, target, universe))
    merged = cut(upsert(old, cleaned.bars))
    before = kept_presence(store, split, sessions, target)
    expected = cut(active_on(before, universe, last_days(sessions, target)))
    missing = cut(missing_report(missing_at_target(expected, merged, target), state))
    ratio = cut(target_coverage(expected, merged, target))
    try:
        enforce(coverage_gate(ratio, minimum_coverage, allow_partial), RefreshError)
    except RefreshError:
        store.save_diagnostics(run, "update_missing", missing)
        store.save_diagnostics(run, "coverage_ratio", ratio)
        raise
    held = store.tables()
    if "partials" in held:
        parts = cut(updated(store.table("partials"), old, merged))
        coverage = cut(refreshed_of_ranges(universe, store.table("coverage"), ranges_of(parts), state))
    else:
        coverage = cut(refresh_coverage(universe, store.table("coverage"), old, merged, state))
    enforce(counted(coverage, {"negative_row_count": F.col("row_count") < 0}), RefreshError)

    first_day = dt.date(start.year, 1, 1)
    stored, seen = store.stage_observed(run, merged, stored_rules(first_day, end))
    path = f"{store.root}/bars/snapshot={run}"
    runs, footers = cut(key_runs(store.spark, path)), cut(stored_codecs(store.spark, path))
    enforce(stored_violations(stored, runs, footers, first_day, end, observed=observed_violations(store.spark, seen)))
    listed = store.stage_files(run, split.kept, runs)
    changed = cut(year_facts(store.spark.createDataFrame([tuple(f) for f in listed], FILE_SCHEMA)))
    counts = {r.year: r.row_count for r in changed.collect()}  # one row per affected year
    empty = sorted(set(years) - set(counts))
    if empty:
        raise RefreshError(f"updated partitions would be empty: {empty}")
    invalid, duplicate = cleaned.counts()
    report = update_report(
        ratio, cleaned.bars, universe, run_id=run, target=target, previous=latest, start=start, years=years,
        minimum=minimum_coverage, allow_partial=allow_partial, invalid_rows=invalid, duplicate_rows=duplicate,
    )
    statistics = manifest_statistics(
        with_carried_years(store, changed, sorted(counts), coverage), coverage, universe_sha256=identity.sha, universe_count=identity.n,
        start=dataset_start, end=end, invalid_rows=invalid, duplicate_rows=duplicate,
    )
    tables = {
        "coverage": coverage, "failures": store.table("failures"), "manifest": with_last_update(statistics, report),
        "update_missing": missing, "update_report": report,
    }
    if "partials" in held:
        tables["partials"] = parts
    if "presence" in held:
        tables["presence"] = merged_presence(before, day_bits(cleaned.bars))
    for name, table in tables.items():
        store.stage_table(run, name, table)
    store.commit(run, counts, list(tables), deltas=dict.fromkeys(counts, 0))
    return Refreshed("updated", target, start, years, run, ratio.first().coverage_ratio)
