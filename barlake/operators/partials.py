"""Rows and date bounds per (ticker, year), kept with a snapshot; coverage and statistics are merged from them.

The table has a row per ticker and year, whatever the number of bars. An update reads the bars it replaces and the bars it
puts in their place, and nothing else: counts are differences, and as an upsert never takes a day away, the bounds only widen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["ticker", "year"]


def partials(bars: DataFrame) -> DataFrame:
    """One pass over the bars: a hash aggregate of fixed width."""
    return bars.groupBy("ticker", F.year("date").alias("year")).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("row_count")
    )


def updated(kept: DataFrame, replaced: DataFrame, merged: DataFrame) -> DataFrame:
    """The kept table after bars were replaced by merged ones, in one aggregate over both."""
    columns = [*KEY, "first_date", "last_date", "row_count"]
    none = F.lit(None).cast("date")

    def signed(bars: DataFrame, sign: int) -> DataFrame:
        day = F.col("date") if sign > 0 else none
        return bars.select("ticker", F.year("date").alias("year"), day.alias("first_date"), day.alias("last_date"), F.lit(sign).cast("bigint").alias("row_count"))

    every = kept.select(*columns).unionByName(signed(replaced, -1)).unionByName(signed(merged, 1))
    return every.groupBy(*KEY).agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.sum("row_count").alias("row_count"))


def ranges_of(table: DataFrame) -> DataFrame:
    """First day, last day and bars per ticker, as operators.coverage.ticker_ranges of the bars."""
    return table.groupBy("ticker").agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.sum("row_count").alias("row_count"))


def years_of(table: DataFrame) -> DataFrame:
    """Bars and date bounds per year, as operators.reports.per_year of the bars."""
    return table.groupBy("year").agg(F.sum("row_count").alias("row_count"), F.min("first_date").alias("min_date"), F.max("last_date").alias("max_date"))
