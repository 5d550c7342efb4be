"""Table schemas, report headers and the other values a dataset's readers rely on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("adj_close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)
BAR_COLUMNS = BAR_SCHEMA.fieldNames()
BAR_KEY = ["date", "ticker"]
BAR_VALUES = ["close", "adj_close", "volume"]

STORED_BAR_SCHEMA = T.StructType([*BAR_SCHEMA.fields, T.StructField("year", T.IntegerType())])

COVERAGE_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("first_date", T.DateType()),
        T.StructField("last_date", T.DateType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("attempt_count", T.LongType()),
        T.StructField("last_error", T.StringType()),
    ]
)
FAILURE_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("attempt_count", T.LongType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)
UPDATE_MISSING_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("expected_active", T.BooleanType()),
        T.StructField("download_status", T.StringType()),
        T.StructField("last_error", T.StringType()),
    ]
)
ATTEMPT_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("attempt_no", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)
UNIVERSE_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("market_cap", T.LongType()),
        T.StructField("market_cap_rank", T.LongType()),
    ]
)
AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("security_name", T.StringType()),
        T.StructField("market_cap", T.LongType()),
        T.StructField("market_cap_rank", T.LongType()),
        T.StructField("yahoo_exchange", T.StringType()),
        T.StructField("listing_exchange", T.StringType()),
        T.StructField("etf", T.StringType()),
        T.StructField("test_issue", T.StringType()),
        T.StructField("quote_type", T.StringType()),
    ]
)
EXCLUDED_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("security_name", T.StringType()),
        T.StructField("yahoo_exchange", T.StringType()),
        T.StructField("listing_exchange", T.StringType()),
        T.StructField("market_cap", T.LongType()),
        T.StructField("exclusion_reason", T.StringType()),
    ]
)
DIRECTORY_SCHEMA = T.StructType(
    [
        T.StructField("raw_symbol", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("security_name", T.StringType()),
        T.StructField("listing_exchange", T.StringType()),
        T.StructField("etf", T.BooleanType()),
        T.StructField("test_issue", T.BooleanType()),
        T.StructField("market_category", T.StringType()),
        T.StructField("financial_status", T.StringType()),
    ]
)
ASSET_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("asset_name", T.StringType()),
        T.StructField("local_path", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
    ]
)
VIOLATION_SCHEMA = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("sample", T.StringType()),
    ]
)

# --- fixed values shared with existing datasets -----------------------------------------
SCHEMA_VERSION = "daily_prices_v1"
SOURCE_NAME = "yahoo_finance_via_yfinance"
DATASET_START = dt.date(2016, 1, 1)
UNIVERSE_SIZE = 2000
MAX_CANDIDATES = 5000
PAGE_SIZE = 250
BATCH_SIZE = 100
MAX_BATCH_SIZE = 250
REFRESH_DAYS = 550
SETTLEMENT_MINUTES = 90
MARKET_TIMEZONE = "America/New_York"
MINIMUM_TARGET_COVERAGE = 0.97
ACTIVE_SESSIONS = 10
STATUSES = ["success", "no_data", "failed"]
IDENTITY_FIELDS = ["schema_version", "universe_sha256", "requested_start", "universe_ticker_count"]
# asset key -> (asset name, path below the dataset root), in publication order
AUXILIARY_ASSETS = {
    "ticker_coverage": ("prices-ticker-coverage.csv", "ticker_coverage.csv"),
    "download_failures": ("prices-download-failures.csv", "download_failures.csv"),
    "update_missing_tickers": ("prices-update-missing-tickers.csv", "update_missing_tickers.csv"),
    "update_report": ("prices-update-report.json", "update_report.json"),
}
MANIFEST_ASSET = ("prices-manifest.json", "manifest.json")
# ----------------------------------------------------------------------------------------
