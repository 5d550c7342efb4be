"""Bars: windows, aggregates, sorts and set operations (W, A, O, U, J4)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barlake.operators import bars as B
from barlake.operators import upsert as up
from barlake.operators.ordering import first_occurrence, in_batches, with_position
from barlake.schema import BATCH_SIZE, MAX_BATCH_SIZE
from barlake.workloads import inputs as I
from barlake.workloads.registry import query

BAR = "date, ticker, close, adj_close, volume"


@query("w1_fold_duplicates", "SELECT * FROM folded")
def w1(spark, sf):
    return B.fold_raw(I.dirty(spark, sf), I.START, I.END).where("copies > 0").drop("invalid")


@query("w1_conflicting_keys", "SELECT date, ticker, copies FROM folded WHERE conflict")
def w1_conflicts(spark, sf):
    return B.conflicts(B.fold_raw(I.dirty(spark, sf), I.START, I.END))


@query("w2_keep_last_by_source", f"SELECT {BAR} FROM merged")
def w2(spark, sf):
    old = I.window_old(spark, sf).withColumn("source", F.lit(0))
    new = I.new_bars(spark, sf).withColumn("source", F.lit(1))
    return up.keep_last_by_source(old.unionByName(new), "source")


@query(
    "w1_fold_typed_feed",
    """SELECT date, ticker, min(close) AS close, min(adj_close) AS adj_close, CAST(min(volume) AS BIGINT) AS volume, count(*) AS copies,
         count(DISTINCT close) > 1 OR count(DISTINCT adj_close) > 1 OR count(DISTINCT volume) > 1 AS conflict
       FROM raw_bars WHERE date >= DATE '1995-07-01' AND date < DATE '2001-07-01' AND close > 0 AND adj_close > 0 GROUP BY date, ticker""",
)
def w1_typed(spark, sf):
    """A typed feed: here the validity filter reaches the scan."""
    return B.fold_keys(B.valid_rows(I.raw_bars(spark, sf), I.START, I.END))


@query("w5_repeated_keys", "SELECT date, ticker, count(*) AS copies FROM raw_bars GROUP BY date, ticker HAVING count(*) > 1")
def w5(spark, sf):
    return B.repeated_keys(I.raw_bars(spark, sf))


@query(
    "w7_batches",
    "SELECT ticker, CAST((row_number() OVER (ORDER BY ticker) - 1) // 100 AS BIGINT) AS batch FROM (SELECT DISTINCT ticker FROM raw_bars)",
)
def w7(spark, sf):
    tickers = I.raw_bars(spark, sf).select("ticker").distinct()
    return in_batches(tickers, [F.col("ticker")], BATCH_SIZE, MAX_BATCH_SIZE).select("ticker", "batch")


@query("w7_global_position", "SELECT date, ticker, row_number() OVER (ORDER BY date, ticker) AS position FROM bars")
def w7_position(spark, sf):
    keys = I.bars(spark, sf).select("date", "ticker")
    return with_position(keys, [F.col("date"), F.col("ticker")])


@query("w8_first_occurrence", "SELECT 'P' || l_partkey AS ticker, min(l_orderkey) AS ord FROM lineitem GROUP BY 1")
def w8(spark, sf):
    lines = I.table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker"), F.col("l_orderkey").alias("ord")
    )
    return first_occurrence(lines, "ticker", "ord")


@query(
    "a1_ticker_ranges",
    "SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS row_count FROM folded WHERE NOT conflict GROUP BY ticker",
)
def a1(spark, sf):
    from barlake.operators.coverage import ticker_ranges

    return ticker_ranges(B.folded_bars(B.fold_raw(I.dirty(spark, sf), I.START, I.END)))


@query("a3_rows_per_year", "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS row_count FROM raw_bars GROUP BY 1")
def a3(spark, sf):
    return B.rows_per_year(I.raw_bars(spark, sf))


@query("a4_date_bounds", "SELECT min(date) AS min_date, max(date) AS max_date FROM raw_bars")
def a4(spark, sf):
    return B.date_bounds(I.raw_bars(spark, sf))


@query("a10_invalid_rows", "SELECT count(*) AS invalid_rows FROM judged WHERE NOT ok")
def a10(spark, sf):
    return B.count_invalid(I.dirty(spark, sf), I.START, I.END)


@query("a11_duplicate_rows", "SELECT CAST(sum(copies - 1) AS BIGINT) AS duplicate_rows FROM folded WHERE NOT conflict")
def a11(spark, sf):
    return B.duplicates_removed(B.fold_raw(I.dirty(spark, sf), I.START, I.END))


@query("a12_distinct_tickers_years", "SELECT count(DISTINCT ticker) AS tickers, count(DISTINCT year(date)) AS years FROM raw_bars")
def a12(spark, sf):
    return B.distinct_tickers_and_years(I.raw_bars(spark, sf))


@query("o1_canonical_sort", f"SELECT {BAR} FROM bars ORDER BY date, ticker")
def o1(spark, sf):
    return B.canonical_sort(I.bars(spark, sf))


@query("u1_union_frames", f"SELECT {BAR} FROM old_bars UNION ALL SELECT {BAR} FROM new_bars")
def u1(spark, sf):
    return I.old_bars(spark, sf).unionByName(I.new_bars(spark, sf))


@query(
    "u3_ticker_intersection",
    "SELECT DISTINCT ticker FROM old_bars INTERSECT SELECT ticker FROM new_bars",
)
def u3(spark, sf):
    return I.old_bars(spark, sf).select("ticker").intersect(I.new_bars(spark, sf).select("ticker"))


@query("u4_key_difference", "SELECT date, ticker FROM new_bars EXCEPT SELECT date, ticker FROM old_bars")
def u4(spark, sf):
    return I.new_bars(spark, sf).select("date", "ticker").subtract(I.old_bars(spark, sf).select("date", "ticker"))


@query(
    "u5_key_set_differences",
    """SELECT ticker, CAST(sum(l) AS BIGINT) AS left_count, CAST(sum(r) AS BIGINT) AS right_count FROM (
         SELECT ticker, 1 AS l, 0 AS r FROM (SELECT DISTINCT ticker FROM raw_bars)
         UNION ALL SELECT 'U' || user_id, 0, 1 FROM events UNION ALL SELECT ticker, 0, 1 FROM parts)
       GROUP BY ticker HAVING sum(l) <> 1 OR sum(r) <> 1""",
)
def u5(spark, sf):
    from barlake.operators.quality import key_set_differences

    left = I.raw_bars(spark, sf).select("ticker").distinct()
    seen = I.table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"))
    return key_set_differences(left, I.parts(spark, sf).select("ticker").unionByName(seen), "ticker")


@query("j4_upsert_window", f"SELECT {BAR} FROM merged")
def j4(spark, sf):
    return up.upsert(I.window_old(spark, sf), I.new_bars(spark, sf))


@query("j4_upsert_window_twice", f"SELECT {BAR} FROM merged")
def j4_twice(spark, sf):
    new = I.new_bars(spark, sf)
    return up.upsert(up.upsert(I.window_old(spark, sf), new), new)


@query("j4_upsert_small_side", f"SELECT {BAR} FROM merged")
def j4_small(spark, sf):
    return up.upsert_small(I.window_old(spark, sf), I.new_bars(spark, sf))
