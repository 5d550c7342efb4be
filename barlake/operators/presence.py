"""Which days a ticker has bars on, as bitmaps that are kept with a snapshot and merged by OR.

A row is (ticker, bucket, days): one bitmap of 64 days, bit 0 of bucket 0 being 1970-01-01. There are never more rows than
bars, and a row has a fixed width, so hash aggregates hold them; a bitmap of all days for a ticker of few would outgrow its bars. A merge reads the
kept bitmaps and the new bars, and answers about past sessions read the bitmaps only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = dt.date(1970, 1, 1)
BITS = 64
KEY = ["ticker", "bucket"]


def day_bits(bars: DataFrame) -> DataFrame:
    """A bitmap per bar, to be merged."""
    number = F.unix_date("date").cast("bigint")
    bit = F.expr(f"shiftleft(1L, CAST(pmod(unix_date(date), {BITS}) AS INT))")
    return bars.select("ticker", F.floor(number / BITS).alias("bucket"), bit.alias("days"))


def presence(bars: DataFrame) -> DataFrame:
    """The bitmaps of some bars: a hash aggregate with map-side combine."""
    return merged(day_bits(bars))


def merged(*tables: DataFrame) -> DataFrame:
    """The bits of all tables; an upsert never takes a bar away, so OR is exact."""
    every = tables[0].select(*KEY, "days")
    for t in tables[1:]:
        every = every.unionByName(t.select(*KEY, "days"))
    return every.groupBy(*KEY).agg(F.bit_or("days").alias("days"))


def has_day(day: dt.date) -> Column:
    """Whether a row of bitmaps has the day's bit."""
    bucket, bit = divmod((day - EPOCH).days, BITS)
    return (F.col("bucket") == bucket) & (F.getbit(F.col("days"), F.lit(bit)) == 1)


def _any(days: list[dt.date]) -> Column:
    found = F.lit(False)
    for day in days:
        found = found | has_day(day)
    return found


def active_on(table: DataFrame, universe: DataFrame, days: list[dt.date]) -> DataFrame:
    """Universe tickers with a bar on one of the days, a list of fixed size; no bar is read."""
    return table.where(_any(days)).select("ticker").distinct().join(universe.select("ticker"), "ticker", "left_semi")


def day_counts(table: DataFrame) -> DataFrame:
    """Days with bars per ticker."""
    return table.groupBy("ticker").agg(F.sum(F.bit_count("days").cast("bigint")).alias("row_count"))


def share_on(table: DataFrame, expected: DataFrame, day: dt.date) -> DataFrame:
    """How many of the expected tickers have a bar on the day: expected_count, present_count, coverage_ratio."""
    here = table.where(has_day(day)).select("ticker").distinct().withColumn("_here", F.lit(True))
    counts = expected.select("ticker").join(here, "ticker", "left").agg(F.count(F.lit(1)).alias("expected_count"), F.count("_here").alias("present_count"))
    ratio = F.when(F.col("expected_count") == 0, F.lit(1.0)).otherwise(F.try_divide("present_count", "expected_count"))
    return counts.withColumn("coverage_ratio", ratio)
