"""backfill: staged raw bars become the first committed snapshot of a dataset."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame

from barlake.errors import DataQualityError, IncompleteError
from barlake.functions.fingerprint import universe_identity
from barlake.operators.coverage import coverage_of_ranges, failure_report, resolve_status, status_counts
from barlake.operators.gates import enforce, gather
from barlake.operators.layers import FILE_SCHEMA, year_facts
from barlake.operators.partials import ranges_of, years_of
from barlake.operators.presence import presence
from barlake.operators.quality import count_mismatches, stored_rules, stored_violations, unexpected_tickers
from barlake.operators.reports import manifest_statistics
from barlake.plans.clean import clean_bars
from barlake.session import cut
from barlake.sinks.bars import observed_violations
from barlake.sinks.layout import manifest_with_assets, publish_csv, publish_json, publish_years
from barlake.sinks.snapshots import BarStore
from barlake.sources.files import inventory, key_runs, stored_codecs
from barlake.operators.inventory import index_assets


@dataclass(frozen=True)
class Backfilled:
    snapshot: str
    coverage: DataFrame
    failures: DataFrame
    manifest: DataFrame


def new_snapshot_id(prefix: str) -> str:
    return f"{prefix}-{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:6]}"


def gate_statuses(coverage: DataFrame, allow_no_data: bool) -> None:
    row = status_counts(coverage).first()
    if row.failed:
        raise IncompleteError(f"{row.failed} failed tickers")
    if row.no_data and not allow_no_data:
        raise IncompleteError(f"{row.no_data} tickers without data")


def backfill(
    store: BarStore,
    universe: DataFrame,
    raw: DataFrame,
    attempts: DataFrame,
    start: dt.date,
    end: dt.date,
    *,
    allow_no_data: bool = False,
) -> Backfilled:
    """universe(ord, ticker); raw bars as staged; attempts as in the attempt log.

    The folded table is written once and read three times: for its rows per ticker and year, from which
    outcomes, counts, coverage and statistics follow, for the days of each ticker, and for the stored files. The files are read once for their order; their value
    rules are counted as they are written. Nothing is visible to
    readers before the final commit.
    """
    snapshot = new_snapshot_id("backfill")
    pinned = store.at()
    cleaned = clean_bars(raw, start, end, universe, materialize=True)
    try:
        cleaned.enforce()
    except DataQualityError:
        store.save_diagnostics(snapshot, "conflicts", cleaned.conflicts)
        raise
    held = cleaned.partials()
    enforce(unexpected_tickers(held, universe))
    state = cut(resolve_status(attempts, universe, held, cleaned.outcomes))
    coverage = cut(coverage_of_ranges(universe, ranges_of(held), state))
    failures = failure_report(coverage, state)
    try:
        gate_statuses(coverage, allow_no_data)
    except IncompleteError:
        store.save_diagnostics(snapshot, "ticker_coverage", coverage)
        store.save_diagnostics(snapshot, "download_failures", failures)
        raise
    stored, seen = store.stage_observed(snapshot, cleaned.bars, stored_rules(start, end))
    path = f"{store.root}/bars/snapshot={snapshot}"
    runs, footers = cut(key_runs(store.spark, path)), cut(stored_codecs(store.spark, path))
    listed = pinned.stage_files(snapshot, [], runs)
    years = cut(year_facts(store.spark.createDataFrame([tuple(f) for f in listed], FILE_SCHEMA)))
    expected = years_of(held).select("year", "row_count")
    observed = observed_violations(store.spark, seen)
    enforce(gather(stored_violations(stored, runs, footers, start, end, observed=observed), count_mismatches(years, expected)))
    invalid, duplicate = cleaned.counts()
    identity = universe_identity(universe).first()
    manifest = manifest_statistics(
        years, coverage, universe_sha256=identity.sha, universe_count=identity.n,
        start=start, end=end, invalid_rows=invalid, duplicate_rows=duplicate,
    )
    tables = {"coverage": coverage, "failures": failures, "manifest": manifest, "presence": presence(cleaned.bars), "partials": held}
    for name, table in tables.items():
        store.stage_table(snapshot, name, table)
    counts = {r.year: r.row_count for r in years.collect()}  # one row per year
    pinned.commit(snapshot, counts, list(tables), deltas=dict.fromkeys(counts, 0))
    return Backfilled(snapshot, coverage, failures, store.table("manifest"))


def export_dataset(store: BarStore, root: str, *, rows_per_file: int | None = None) -> DataFrame:
    """The committed dataset as plain named files with a manifest; returns the manifest row.

    A year is one file, or as many numbered parts as Spark or `rows_per_file` make of it; no year has to fit one task.
    """
    publish_years(store.bars(), root, rows_per_file=rows_per_file)
    publish_csv(store.table("coverage"), root, "ticker_coverage.csv", ["ticker"])
    publish_csv(store.table("failures"), root, "download_failures.csv", ["ticker"])
    held = store.tables()
    if "update_report" in held:
        publish_csv(store.table("update_missing"), root, "update_missing_tickers.csv", ["ticker"])
        publish_json(store.table("update_report"), root, "update_report.json")
    assets = index_assets(inventory(store.spark, root))
    manifest = manifest_with_assets(store.table("manifest"), assets)
    publish_json(manifest, root, "manifest.json")
    return manifest
