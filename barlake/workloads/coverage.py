"""Coverage, status, calendar and gate queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barlake.operators import calendar as C
from barlake.operators import coverage as V
from barlake.operators import quality as Q
from barlake.operators import reports as R
from barlake.operators.upsert import upsert, upsert_violations
from barlake.workloads import inputs as I
from barlake.workloads.registry import query


def merged(spark, sf):
    return upsert(I.window_old(spark, sf), I.new_bars(spark, sf))


def state(spark, sf):
    return V.resolve_status(I.attempts(spark, sf), I.users(spark, sf), I.user_bars(spark, sf))


def coverage(spark, sf):
    return V.build_coverage(I.users(spark, sf), I.user_bars(spark, sf), state(spark, sf))


def active(spark, sf):
    return V.expected_active(I.window_old(spark, sf), I.parts(spark, sf), I.sessions(spark, sf), I.TARGET)


@query(
    "j3_unexpected_tickers",
    """SELECT 'unexpected_ticker' AS rule, count(DISTINCT user_id) AS n,
         (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT 'V' || user_id AS t FROM events ORDER BY t LIMIT 10)) AS sample FROM events""",
)
def j3(spark, sf):
    """Tickers of the event users and the bar parts against a universe that knows only the parts."""
    strangers = I.table(spark, sf, "events").select(F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("ticker"))
    return Q.unexpected_tickers(I.raw_bars(spark, sf).select("ticker").unionByName(strangers), I.parts(spark, sf))


@query("j5_build_coverage", "SELECT * FROM coverage")
def j5(spark, sf):
    return coverage(spark, sf)


@query(
    "j6_failure_report",
    """SELECT c.ticker, c.status, c.attempt_count, s.error_type, s.error_message FROM coverage c JOIN state s ON s.ticker = c.ticker
       WHERE c.status <> 'success'""",
)
def j6(spark, sf):
    return V.failure_report(coverage(spark, sf), state(spark, sf))


@query(
    "j7_incremental_coverage",
    """SELECT p.ticker, CASE WHEN f.n > 0 THEN 'success' ELSE 'no_data' END AS status, f.first_date, f.last_date,
         coalesce(f.n, 0) AS row_count, CAST(4 AS BIGINT) AS attempt_count, 'nothing new' AS last_error
       FROM parts p LEFT JOIN (SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM (
         SELECT date, ticker FROM old_bars UNION SELECT date, ticker FROM new_bars) GROUP BY ticker) f ON f.ticker = p.ticker""",
)
def j7(spark, sf):
    """Incremental result against the SQL twin's full recomputation."""
    parts = I.parts(spark, sf)
    zero = parts.select("ticker", F.lit("no_data").alias("status"), F.lit(3).cast("bigint").alias("attempt_count"), F.lit("").alias("error_message"))
    prior = V.build_coverage(parts, I.old_bars(spark, sf), zero)
    run = parts.select("ticker", F.lit("no_data").alias("status"), F.lit(1).cast("bigint").alias("attempt_count"), F.lit("nothing new").alias("error_message"))
    return V.refresh_coverage(parts, prior, I.window_old(spark, sf), merged(spark, sf), run)


@query("j8_expected_active", "SELECT ticker FROM active")
def j8(spark, sf):
    return active(spark, sf)


@query("j9_missing_at_target", "SELECT ticker FROM active WHERE ticker NOT IN (SELECT ticker FROM present)")
def j9(spark, sf):
    return V.missing_at_target(active(spark, sf), merged(spark, sf), I.TARGET)


@query(
    "j10_missing_report",
    """SELECT p.ticker, true AS expected_active, coalesce(s.status, 'unknown') AS download_status, coalesce(s.error_message, '') AS last_error
       FROM (SELECT ticker FROM users UNION ALL SELECT ticker FROM parts) p LEFT JOIN state s ON s.ticker = p.ticker
       WHERE p.ticker NOT IN (SELECT ticker FROM user_bars WHERE date = DATE '2024-01-30')""",
)
def j10(spark, sf):
    expected = I.users(spark, sf).select("ticker").unionByName(I.parts(spark, sf).select("ticker"))
    missing = V.missing_at_target(expected, I.user_bars(spark, sf), dt.date(2024, 1, 30))
    return V.missing_report(missing, state(spark, sf))


@query("a2_status_counts", "SELECT count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'no_data') AS no_data, count(*) FILTER (WHERE status = 'failed') AS failed FROM coverage")
def a2(spark, sf):
    return V.status_counts(coverage(spark, sf))


@query(
    "a7_target_coverage",
    """SELECT count(*) AS expected_count, count(p.ticker) AS present_count, round(count(p.ticker) / count(*), 6) AS coverage_ratio
       FROM active a LEFT JOIN present p ON p.ticker = a.ticker""",
)
def a7(spark, sf):
    ratio = V.target_coverage(active(spark, sf), merged(spark, sf), I.TARGET)
    return ratio.withColumn("coverage_ratio", F.round("coverage_ratio", 6))


@query(
    "a8_universe_coverage",
    """SELECT (SELECT count(*) FROM bars WHERE date = DATE '2000-06-14') AS present_count, (SELECT count(*) FROM parts) AS universe_count,
         round((SELECT count(*) FROM bars WHERE date = DATE '2000-06-14') / (SELECT count(*) FROM parts), 6) AS coverage_ratio""",
)
def a8(spark, sf):
    ratio = V.universe_coverage(I.bars(spark, sf), I.parts(spark, sf), dt.date(2000, 6, 14))
    return ratio.withColumn("coverage_ratio", F.round("coverage_ratio", 6))


@query("a15_resolve_status", "SELECT * FROM state")
def a15(spark, sf):
    return state(spark, sf)


@query("a16_attempt_totals", "SELECT ticker, count(*) AS attempt_count FROM attempts GROUP BY ticker")
def a16(spark, sf):
    return V.attempt_totals(I.attempts(spark, sf))


@query(
    "a18_update_report",
    """SELECT (SELECT count(*) FROM active) AS expected_active_ticker_count,
         (SELECT count(*) FROM active WHERE ticker IN (SELECT ticker FROM present)) AS target_session_ticker_count,
         (SELECT count(*) FROM active WHERE ticker NOT IN (SELECT ticker FROM present)) AS missing_ticker_count,
         (SELECT count(*) FROM new_bars) AS downloaded_row_count, (SELECT count(*) FROM parts) AS universe_ticker_count,
         '1999-12-12' AS refresh_start, '2001-06-14' AS target_session""",
)
def a18(spark, sf):
    report = R.update_report(
        V.target_coverage(active(spark, sf), merged(spark, sf), I.TARGET), I.new_bars(spark, sf), I.parts(spark, sf),
        run_id="run", target=I.TARGET, previous=I.OLD_END, start=I.WINDOW_START, years=[1999, 2000, 2001], minimum=0.97, allow_partial=False,
    )
    return report.select(
        "expected_active_ticker_count", "target_session_ticker_count", "missing_ticker_count", "downloaded_row_count",
        "universe_ticker_count", "refresh_start", "target_session",
    )


def statistics(spark, sf):
    users = I.users(spark, sf)
    return R.manifest_statistics(
        R.per_year(I.bars(spark, sf)), coverage(spark, sf), universe_sha256="0" * 64, universe_count=1, start=I.START, end=I.END
    )


@query(
    "a19_manifest_statistics",
    """SELECT (SELECT count(*) FROM bars) AS total_row_count, (SELECT CAST(min(date) AS VARCHAR) FROM bars) AS actual_min_date,
         (SELECT CAST(max(date) AS VARCHAR) FROM bars) AS actual_max_date,
         (SELECT count(*) FROM coverage WHERE status = 'success') AS successful_ticker_count,
         (SELECT count(*) FROM coverage WHERE status = 'no_data') AS no_data_ticker_count,
         (SELECT count(*) FROM coverage WHERE status = 'failed') AS failed_ticker_count,
         (SELECT string_agg(y || '=' || n, ',' ORDER BY y) FROM (SELECT year(date) AS y, count(*) AS n FROM bars GROUP BY 1)) AS per_year""",
)
def a19(spark, sf):
    pairs = F.transform(F.map_entries("partition_row_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return statistics(spark, sf).select(
        "total_row_count", "actual_min_date", "actual_max_date", "successful_ticker_count", "no_data_ticker_count",
        "failed_ticker_count", F.array_join(pairs, ",").alias("per_year"),
    )


@query(
    "a20_acceptance_summary",
    """SELECT (SELECT count(*) FROM bars) AS total_row_count, (SELECT count(*) FROM coverage WHERE status = 'success') AS successful_ticker_count,
         '2000-06-14' AS target_session, (SELECT count(*) FROM bars WHERE date = DATE '2000-06-14') AS target_session_ticker_count,
         CAST(0 AS BIGINT) AS duplicate_key_count""",
)
def a20(spark, sf):
    day = dt.date(2000, 6, 14)
    share = V.universe_coverage(I.bars(spark, sf), I.parts(spark, sf), day)
    return R.acceptance_summary(statistics(spark, sf), share, day).select(
        "total_row_count", "successful_ticker_count", "target_session", "target_session_ticker_count", "duplicate_key_count"
    )


@query(
    "j12_set_equality",
    """SELECT ticker, CAST(sum(l) AS BIGINT) AS left_count, CAST(sum(r) AS BIGINT) AS right_count FROM (
         SELECT ticker, 1 AS l, 0 AS r FROM coverage UNION ALL SELECT 'U' || user_id, 0, 1 FROM (SELECT DISTINCT user_id FROM events))
       GROUP BY ticker HAVING sum(l) <> 1 OR sum(r) <> 1""",
)
def j12(spark, sf):
    seen = I.table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker")).distinct()
    return Q.key_set_differences(coverage(spark, sf), seen, "ticker")


def requests(spark, sf):
    """One request per order: its priority shifts the hour of day at which it asks."""
    hour = F.substring("o_orderpriority", 1, 1).cast("int") * 5 - 2
    at = F.to_date("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=hour, mins=F.lit(30))
    return I.table(spark, sf, "orders").select("o_orderkey", at.alias("now_utc"))


SQL_REQUESTS = """(SELECT o_orderkey, CAST(o_orderdate AS DATE) + to_hours(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 5 - 2) + INTERVAL 30 MINUTE AS now_utc FROM orders)"""


@query(
    "j15_latest_settled_session",
    f"""SELECT r.o_orderkey, r.now_utc, s.session AS resolved FROM {SQL_REQUESTS} r
        ASOF LEFT JOIN (SELECT session, close_utc + INTERVAL 90 MINUTE AS ready FROM sessions) s ON r.now_utc >= s.ready""",
)
def j15(spark, sf):
    return C.latest_settled(requests(spark, sf), I.sessions(spark, sf))


@query(
    "j15_latest_started_session",
    f"""SELECT r.o_orderkey, r.now_utc, s.session AS resolved FROM (
          SELECT *, CAST((now_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day FROM {SQL_REQUESTS}) r
        ASOF LEFT JOIN (SELECT session FROM sessions) s ON r.day >= s.session""",
)
def j15_started(spark, sf):
    return C.latest_started(requests(spark, sf), I.sessions(spark, sf))


@query(
    "j15_explicit_targets",
    f"""SELECT r.o_orderkey, CASE WHEN s.session IS NULL THEN 'not_a_session' WHEN s.close_utc + INTERVAL 90 MINUTE > r.now_utc THEN 'not_settled' END AS problem
        FROM {SQL_REQUESTS} r LEFT JOIN (SELECT * FROM sessions) s ON s.session = CAST(r.now_utc AS DATE)""",
)
def j15_targets(spark, sf):
    asked = requests(spark, sf).withColumn("target", F.to_date("now_utc"))
    return C.check_targets(asked, I.sessions(spark, sf)).select("o_orderkey", "problem")


@query("j16_previous_sessions", "SELECT session FROM recent")
def j16(spark, sf):
    return C.previous_sessions(I.sessions(spark, sf), I.TARGET)


VALUE_RULES = """{'rule': 'null_value', 'n': count(*) FILTER (WHERE date IS NULL)},
    {'rule': 'close_not_positive_finite', 'n': count(*) FILTER (WHERE NOT isfinite(close) OR close <= 0)},
    {'rule': 'adj_close_not_positive_finite', 'n': count(*) FILTER (WHERE NOT isfinite(adj_close) OR adj_close <= 0)},
    {'rule': 'negative_volume', 'n': count(*) FILTER (WHERE CAST(volume AS BIGINT) < 0)},
    {'rule': 'date_out_of_range', 'n': count(*) FILTER (WHERE date < DATE '1995-07-01' OR date >= DATE '2001-07-01')}"""


def stored_dirty(spark, sf):
    return I.dirty(spark, sf).withColumn("volume", F.round("volume").cast("bigint"))


@query(
    "v1_normalised_rows_gate",
    f"""SELECT * FROM (SELECT unnest([{VALUE_RULES},
          {{'rule': 'duplicate_key', 'n': (SELECT count(*) FROM (SELECT date, ticker FROM dirty GROUP BY date, ticker HAVING count(*) > 1))}}
        ], recursive := true) FROM dirty) WHERE n > 0""",
)
def v1(spark, sf):
    return Q.bar_violations(stored_dirty(spark, sf), I.START, I.END, I.parts(spark, sf)).select("rule", "n")


@query("v2_typed_table_gate", f"SELECT * FROM (SELECT unnest([{VALUE_RULES}], recursive := true) FROM dirty) WHERE n > 0")
def v2(spark, sf):
    return Q.typed_violations(stored_dirty(spark, sf), I.START, I.END, I.parts(spark, sf)).select("rule", "n")


@query(
    "j4_upsert_preconditions",
    """SELECT * FROM (SELECT unnest([
          {'rule': 'date_out_of_range', 'n': (SELECT count(*) FROM bars WHERE date < DATE '1999-12-12' OR date > DATE '2001-06-14')},
          {'rule': 'old_rows_after_target', 'n': (SELECT count(*) FROM bars WHERE date > DATE '2001-06-14')}], recursive := true)) WHERE n > 0""",
)
def j4_gate(spark, sf):
    every = I.bars(spark, sf)
    return upsert_violations(every, every, I.WINDOW_START, I.TARGET, I.parts(spark, sf)).select("rule", "n")


@query(
    "v9_target_coverage_gate",
    """SELECT 'target_coverage' AS rule, CAST(1 AS BIGINT) AS n FROM (SELECT count(p.ticker) / count(*) AS r FROM active a LEFT JOIN present p ON p.ticker = a.ticker)
       WHERE r < 0.97""",
)
def v9(spark, sf):
    return Q.coverage_gate(V.target_coverage(active(spark, sf), merged(spark, sf), I.TARGET)).select("rule", "n")


@query(
    "v5_coverage_acceptance",
    """SELECT * FROM (SELECT unnest([
          {'rule': 'coverage_not_universe', 'n': (SELECT count(*) FROM users WHERE ticker NOT IN (SELECT 'U' || user_id FROM events))},
          {'rule': 'status_not_success', 'n': count(*) FILTER (WHERE status <> 'success')},
          {'rule': 'no_rows', 'n': count(*) FILTER (WHERE row_count <= 0)},
          {'rule': 'first_after_last', 'n': count(*) FILTER (WHERE first_date IS NULL)},
          {'rule': 'leftover_error', 'n': count(*) FILTER (WHERE last_error <> '')}], recursive := true) FROM coverage) WHERE n > 0""",
)
def v5(spark, sf):
    """Coverage of all users judged against a universe of those who occur in the events."""
    seen = I.table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker")).distinct()
    return Q.coverage_row_violations(coverage(spark, sf), seen).select("rule", "n")
