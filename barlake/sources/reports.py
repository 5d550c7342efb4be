"""Coverage and failure reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.schema import COVERAGE_SCHEMA, FAILURE_SCHEMA, UPDATE_MISSING_SCHEMA
from barlake.sources.universe import read_exact_csv


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """Blank dates read as NULL, blank errors as empty text."""
    return read_exact_csv(spark, path, COVERAGE_SCHEMA).withColumn("last_error", F.coalesce("last_error", F.lit("")))


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return read_exact_csv(spark, path, FAILURE_SCHEMA).withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ("error_type", "error_message")}
    )


def read_missing(spark: SparkSession, path: str) -> DataFrame:
    return read_exact_csv(spark, path, UPDATE_MISSING_SCHEMA).withColumn("last_error", F.coalesce("last_error", F.lit("")))
