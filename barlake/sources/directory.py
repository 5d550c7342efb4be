"""Symbol directories: pipe-separated files, the two listing layouts and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.errors import SourceError
from barlake.functions.text import blank_to_null, exchange_name, flag, normalize_ticker, strip
from barlake.operators.gates import gather, sampled
from barlake.schema import DIRECTORY_SCHEMA

# --- fixed values: columns the two layouts must have, footer marker ---------------------
LISTED_A_COLUMNS = ["Symbol", "Security Name", "Market Category", "ETF", "Test Issue", "Financial Status"]
LISTED_B_COLUMNS = ["ACT Symbol", "Security Name", "Exchange", "CQS Symbol", "ETF", "Test Issue", "NASDAQ Symbol"]
FOOTER = "file creation time"
SYMBOL_PREFERENCE = ["NASDAQ Symbol", "ACT Symbol", "CQS Symbol"]
# ----------------------------------------------------------------------------------------


def read_pipe(spark: SparkSession, path: str | list[str], required: list[str]) -> DataFrame:
    """Trimmed text columns; footer and all-blank rows dropped."""
    raw = spark.read.csv(path, sep="|", header=True, quote='"', escape='"')
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    missing = sorted(set(required) - set(names))
    if missing:
        raise SourceError(f"missing required columns: {', '.join(missing)}")
    first = F.lower(F.coalesce(strip(F.col(f"`{names[0]}`")), F.lit("")))
    values = [blank_to_null(F.col(f"`{n}`")) for n in names]
    renamed = raw.toDF(*names)
    return renamed.where(~first.startswith(FOOTER)).where(F.coalesce(*values).isNotNull()).select(
        *[F.coalesce(strip(F.col(f"`{n}`")), F.lit("")).alias(n) for n in names]
    )


def _record(df: DataFrame, symbol: Column, exchange: Column, category: Column, status: Column, critical: Column) -> DataFrame:
    problem = F.when(critical, "invalid_critical_field").when(
        flag(F.col("ETF")).isNull(), "invalid_etf_flag"
    ).when(flag(F.col("Test Issue")).isNull(), "invalid_test_issue_flag")
    return df.select(
        symbol.alias("raw_symbol"),
        normalize_ticker(symbol).alias("ticker"),
        F.col("Security Name").alias("security_name"),
        exchange.alias("listing_exchange"),
        flag(F.col("ETF")).alias("etf"),
        flag(F.col("Test Issue")).alias("test_issue"),
        category.alias("market_category"),
        status.alias("financial_status"),
        problem.alias("problem"),
    )


def parse_listed_a(rows: DataFrame) -> DataFrame:
    """Records of the first layout plus `problem`, NULL for a sound row."""
    category = F.upper("Market Category")
    status = F.upper("Financial Status")
    critical = (
        normalize_ticker(F.col("Symbol")).isNull()
        | (F.col("Security Name") == "")
        | (category == "")
        | (status == "")
    )
    return _record(rows, F.col("Symbol"), F.lit("NASDAQ"), category, status, critical)


def parse_listed_b(rows: DataFrame) -> DataFrame:
    """Records of the second layout; the first symbol column that normalises is used."""
    symbol = F.coalesce(
        *[F.when(normalize_ticker(F.col(f"`{c}`")).isNotNull(), F.col(f"`{c}`")) for c in SYMBOL_PREFERENCE], F.lit("")
    )
    exchange = exchange_name(F.col("Exchange"))
    critical = normalize_ticker(symbol).isNull() | (F.col("Security Name") == "") | exchange.isNull()
    nothing = F.lit(None).cast("string")
    return _record(rows, symbol, exchange, nothing, nothing, critical)


def combine(*parsed: DataFrame) -> DataFrame:
    """Union folded to distinct records with their copies, so identical repeats are one row."""
    rows = gather(*parsed)
    return rows.groupBy(*DIRECTORY_SCHEMA.fieldNames(), "problem").agg(F.count(F.lit(1)).alias("copies"))


def conflicting_tickers(combined: DataFrame) -> DataFrame:
    """Tickers with more than one distinct record."""
    return combined.groupBy("ticker").agg(F.count(F.lit(1)).alias("records")).where("records > 1")


def directory(combined: DataFrame) -> DataFrame:
    return combined.where("problem IS NULL").select(*DIRECTORY_SCHEMA.fieldNames())


def raw_record_count(combined: DataFrame) -> DataFrame:
    return combined.agg(F.sum("copies").alias("raw_record_count"))


def directory_violations(combined: DataFrame) -> DataFrame:
    bad = combined.where("problem IS NOT NULL")
    label = F.concat_ws(" ", "problem", "raw_symbol", "security_name")
    empty = combined.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("directory").alias("n"))
    return gather(
        sampled(bad, "invalid_record", label),
        sampled(conflicting_tickers(combined), "conflicting_records", F.col("ticker")),
        sampled(empty, "no_records", F.col("n")),
    )
