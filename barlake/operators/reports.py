"""One-row report aggregates of a dataset and of a refresh."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators.coverage import status_counts
from barlake.schema import AUXILIARY_ASSETS, MANIFEST_ASSET, SCHEMA_VERSION, SOURCE_NAME

#: The reports that a refresh publishes besides the changed years, and the manifest last.
UPDATE_FILES = [*(AUXILIARY_ASSETS[k][1] for k in ("ticker_coverage", "update_missing_tickers", "update_report")), MANIFEST_ASSET[1]]


def single(*rows: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    out = rows[0]
    for r in rows[1:]:
        out = out.join(r, F.lit(True))
    return out


def year_count_map(counts: DataFrame) -> DataFrame:
    """year -> row count, one entry per year."""
    entry = F.struct(F.col("year").cast("string").alias("year"), "row_count")
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("partition_row_counts"))


def per_year(bars: DataFrame) -> DataFrame:
    """Rows and date bounds per year, the only pass over the bars that the statistics need."""
    return bars.groupBy(F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("date").alias("min_date"), F.max("date").alias("max_date")
    )


def manifest_statistics(
    years: DataFrame,
    coverage: DataFrame,
    *,
    universe_sha256: str,
    universe_count: int,
    start: dt.date,
    end: dt.date,
    invalid_rows: int = 0,
    duplicate_rows: int = 0,
    completed: bool = True,
) -> DataFrame:
    """The manifest without its assets, from per_year() and the coverage table."""
    totals = years.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_row_count"),
        F.min("min_date").cast("string").alias("actual_min_date"),
        F.max("max_date").cast("string").alias("actual_max_date"),
    )
    counts = status_counts(coverage).select(
        F.col("success").alias("successful_ticker_count"),
        F.col("no_data").alias("no_data_ticker_count"),
        F.col("failed").alias("failed_ticker_count"),
    )
    return single(totals, counts, year_count_map(years)).withColumns(
        {
            "schema_version": F.lit(SCHEMA_VERSION),
            "source": F.lit(SOURCE_NAME),
            "universe_sha256": F.lit(universe_sha256),
            "universe_ticker_count": F.lit(universe_count),
            "requested_start": F.lit(start.isoformat()),
            "requested_end_exclusive": F.lit(end.isoformat()),
            "latest_session": F.col("actual_max_date"),
            "invalid_rows_removed": F.lit(invalid_rows),
            "duplicate_rows_removed": F.lit(duplicate_rows),
            "last_successful_update_utc": F.lit(dt.datetime.now(dt.UTC).isoformat()),
            "completed": F.lit(completed),
        }
    )


def with_last_update(statistics: DataFrame, report: DataFrame) -> DataFrame:
    """The manifest's fields that tell of the refresh which made it."""
    told = {
        "last_update_run_id": "run_id", "last_update_refresh_start": "refresh_start", "last_update_target_session": "target_session",
        "last_update_target_coverage_ratio": "target_session_coverage_ratio", "last_update_invalid_rows_removed": "invalid_rows_removed",
        "last_update_duplicate_rows_removed": "duplicate_rows_removed",
    }
    return single(statistics, report.select(*[F.col(own).alias(name) for name, own in told.items()]))


def update_report(
    coverage_ratio: DataFrame,
    new_rows: DataFrame,
    universe: DataFrame,
    *,
    run_id: str,
    target: dt.date,
    previous: dt.date,
    start: dt.date,
    years: list[int],
    minimum: float,
    allow_partial: bool,
    invalid_rows: int = 0,
    duplicate_rows: int = 0,
) -> DataFrame:
    ratio = coverage_ratio.select(
        F.col("expected_count").alias("expected_active_ticker_count"),
        F.col("present_count").alias("target_session_ticker_count"),
        F.col("coverage_ratio").alias("target_session_coverage_ratio"),
        (F.col("expected_count") - F.col("present_count")).alias("missing_ticker_count"),
    )
    loaded = new_rows.agg(F.count(F.lit(1)).alias("downloaded_row_count"))
    size = universe.agg(F.count(F.lit(1)).alias("universe_ticker_count"))
    return single(ratio, loaded, size).withColumns(
        {
            "run_id": F.lit(run_id),
            "target_session": F.lit(target.isoformat()),
            "previous_latest_session": F.lit(previous.isoformat()),
            "refresh_start": F.lit(start.isoformat()),
            "changed_partition_years": F.lit(years),
            "changed_files": F.array(*[F.lit(f"daily/year={y}/prices.parquet") for y in years], *[F.lit(x) for x in UPDATE_FILES]),
            "minimum_target_coverage_ratio": F.lit(minimum),
            "allow_partial_session": F.lit(allow_partial),
            "invalid_rows_removed": F.lit(invalid_rows),
            "duplicate_rows_removed": F.lit(duplicate_rows),
            "unresolved_failure_count": F.lit(0),
            "local_update_success": F.lit(True),
            "success": F.lit(True),
        }
    )


def acceptance_summary(statistics: DataFrame, target_coverage: DataFrame | None, target: dt.date | None) -> DataFrame:
    """Summary of an accepted dataset; violation counts are zero once the gates passed."""
    row = statistics.select(
        "requested_start",
        "actual_min_date",
        "actual_max_date",
        "universe_sha256",
        "universe_ticker_count",
        "successful_ticker_count",
        "no_data_ticker_count",
        "failed_ticker_count",
        "total_row_count",
        "partition_row_counts",
    ).withColumns(
        {
            n: F.lit(0).cast("bigint")
            for n in ("duplicate_key_count", "null_count", "nonpositive_close_count", "nonpositive_adj_close_count", "negative_volume_count")
        }
    )
    if target_coverage is None:
        return row.withColumns(
            {
                "target_session": F.lit(None).cast("string"),
                "target_session_ticker_count": F.lit(0).cast("bigint"),
                "target_session_coverage_ratio": F.lit(None).cast("double"),
            }
        )
    share = target_coverage.select(
        F.col("present_count").alias("target_session_ticker_count"),
        F.col("coverage_ratio").alias("target_session_coverage_ratio"),
    )
    return single(row.withColumn("target_session", F.lit(target.isoformat())), share)
