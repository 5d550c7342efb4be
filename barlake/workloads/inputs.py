"""Bars, feeds, directories, sessions and attempt logs derived from the test tables.

Every input is a rule over whole tables. The rules damage some rows on purpose (bad dates,
negative prices, odd spellings of a market cap), so that each branch of an operator is taken;
they never drop rows to make a query smaller. CTES holds the same rules as SQL.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.schema import UNIVERSE_SIZE
from barlake.session import scratch
from barlake.sinks.bars import write_years

START = dt.date(1995, 7, 1)
END = dt.date(2001, 7, 1)
OLD_END = dt.date(2001, 6, 1)
TARGET = dt.date(2001, 6, 14)
WINDOW_START = TARGET - dt.timedelta(days=550)
USERS_START = dt.date(2024, 1, 1)
USERS_END = dt.date(2024, 2, 1)
USERS_LATE = dt.date(2024, 1, 6)
#: Raw rows of a task that folds them into bars, about.
ROWS_PER_TASK = 1 << 19

CTES = {
    "raw_bars": """
        SELECT CAST(l_shipdate AS DATE) AS date, 'P' || l_partkey AS ticker, l_extendedprice AS close,
               l_extendedprice * (1 - l_discount) AS adj_close, l_quantity AS volume
        FROM lineitem""",
    "bars": """
        SELECT date, ticker, max(close) AS close, max(adj_close) AS adj_close,
               CAST(max(volume) AS BIGINT) AS volume
        FROM raw_bars GROUP BY date, ticker""",
    "lines": "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'A'",
    "dirty": """
        SELECT CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN NULL
                    ELSE CAST(l_shipdate AS DATE) END AS date,
               'P' || l_partkey AS ticker,
               CASE WHEN l_discount > 0.005 THEN l_extendedprice
                    WHEN l_linenumber = 2 THEN CAST('NaN' AS DOUBLE)
                    WHEN l_linenumber = 3 THEN -1.0
                    WHEN l_linenumber = 4 THEN CAST('Infinity' AS DOUBLE)
                    ELSE l_extendedprice END AS close,
               CASE WHEN l_linenumber = 5 AND l_discount < 0.005 THEN 0.0
                    ELSE l_extendedprice * (1 - l_discount) END AS adj_close,
               CASE WHEN l_tax > 0.005 THEN l_quantity
                    WHEN l_linenumber = 1 THEN l_quantity + 0.5
                    WHEN l_linenumber = 2 THEN -l_quantity
                    WHEN l_linenumber = 3 THEN l_quantity + 0.0000000001
                    ELSE l_quantity END AS volume
        FROM lines""",
    "judged": """
        SELECT *, coalesce(date >= DATE '1995-07-01' AND date < DATE '2001-07-01'
                  AND isfinite(close) AND close > 0 AND isfinite(adj_close) AND adj_close > 0
                  AND isfinite(volume) AND volume >= 0 AND abs(volume - round_even(volume, 0)) <= 1e-9, false) AS ok
        FROM dirty""",
    "valid": """
        SELECT date, ticker, close, adj_close, CAST(round_even(volume, 0) AS BIGINT) AS volume
        FROM judged WHERE ok""",
    "folded": """
        SELECT date, ticker, min(close) AS close, min(adj_close) AS adj_close, min(volume) AS volume,
               count(*) AS copies,
               count(DISTINCT close) > 1 OR count(DISTINCT adj_close) > 1 OR count(DISTINCT volume) > 1 AS conflict
        FROM valid GROUP BY date, ticker""",
    "old_bars": "SELECT * FROM bars WHERE date < DATE '2001-06-01'",
    "new_bars": """
        SELECT date, ticker, close * 2 AS close, adj_close * 2 AS adj_close, volume + 1 AS volume
        FROM bars WHERE date >= DATE '1999-12-12' AND date <= DATE '2001-06-14' AND volume <> 7""",
    "window_old": "SELECT * FROM old_bars WHERE date >= DATE '1999-01-01'",
    "merged": """
        SELECT date, ticker, close, adj_close, volume FROM (
          SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY src DESC) AS rn
          FROM (SELECT *, 0 AS src FROM window_old UNION ALL SELECT *, 1 AS src FROM new_bars))
        WHERE rn = 1""",
    "parts": "SELECT p_partkey AS ord, 'P' || p_partkey AS ticker FROM part",
    "sessions": """
        SELECT DISTINCT CAST(o_orderdate AS DATE) AS session, CAST(o_orderdate AS DATE) + INTERVAL 21 HOUR AS close_utc
        FROM orders WHERE isodow(o_orderdate) < 6""",
    "recent": "SELECT session FROM sessions WHERE session < DATE '2001-06-14' ORDER BY session DESC LIMIT 10",
    "active": """
        SELECT DISTINCT ticker FROM window_old
        WHERE date IN (SELECT session FROM recent) AND ticker IN (SELECT ticker FROM parts)""",
    "present": "SELECT DISTINCT ticker FROM merged WHERE date = DATE '2001-06-14'",
    "users": "SELECT c_custkey AS ord, 'U' || c_custkey AS ticker FROM customer",
    "user_bars": """
        SELECT CAST(ts AS DATE) AS date, 'U' || user_id AS ticker, max(value) + 1 AS close,
               max(value) + 0.5 AS adj_close, count(*) AS volume
        FROM events GROUP BY 1, 2""",
    "attempts": """
        SELECT 'U' || user_id AS ticker, event_id AS attempt_no,
               CASE WHEN event_type = 'error' AND value > 40 THEN 'failed'
                    WHEN event_type = 'signup' AND value > 45 THEN 'success' ELSE 'no_data' END AS outcome,
               CASE WHEN event_type = 'error' AND value > 40 THEN 'E' || (event_id % 7) ELSE '' END AS error_type,
               'try  ' || event_id || '?key=' || user_id || '&n=1' AS message
        FROM events""",
    "state": """
        SELECT u.ticker,
               CASE WHEN r.ticker IS NOT NULL THEN 'success' WHEN coalesce(bad, false) THEN 'failed'
                    WHEN coalesce(nothing, false) THEN 'no_data' ELSE 'failed' END AS status,
               coalesce(n, 0) AS attempt_count,
               CASE WHEN r.ticker IS NOT NULL THEN ''
                    WHEN coalesce(bad, false) THEN CASE WHEN last_outcome = 'no_data' THEN 'NoData' ELSE last_type END
                    WHEN coalesce(nothing, false) THEN 'NoData' ELSE 'DownloadError' END AS error_type,
               CASE WHEN r.ticker IS NOT NULL THEN ''
                    WHEN coalesce(bad, false) THEN
                      CASE WHEN last_outcome = 'no_data' THEN 'the last attempt found no usable rows'
                           ELSE 'try ' || last_id || '?key=<redacted>&n=1' END
                    WHEN coalesce(nothing, false) THEN 'no attempt found usable rows'
                    ELSE 'no attempt was recorded' END AS error_message
        FROM users u LEFT JOIN (
          SELECT ticker, bool_or(outcome = 'failed') AS bad,
                 bool_or(outcome = 'no_data') AS nothing, count(*) AS n,
                 arg_max(outcome, attempt_no) AS last_outcome, arg_max(error_type, attempt_no) AS last_type,
                 max(attempt_no) AS last_id
          FROM attempts GROUP BY ticker) a ON a.ticker = u.ticker
        LEFT JOIN (SELECT DISTINCT ticker FROM user_bars) r ON r.ticker = u.ticker""",
    "user_ranges": """
        SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS row_count
        FROM user_bars GROUP BY ticker""",
    "coverage": """
        SELECT u.ticker, CASE WHEN r.ticker IS NOT NULL THEN 'success' ELSE s.status END AS status,
               r.first_date, r.last_date, coalesce(r.row_count, 0) AS row_count, s.attempt_count,
               CASE WHEN r.ticker IS NOT NULL THEN '' WHEN s.error_message = '' THEN 'no status is known'
                    ELSE s.error_message END AS last_error
        FROM users u JOIN state s ON s.ticker = u.ticker LEFT JOIN user_ranges r ON r.ticker = u.ticker""",
    "feed_base": """
        SELECT c_custkey AS k, c_nationkey AS n, c_name AS name, c_mktsegment AS seg,
               CAST(round(c_acctbal * 100) AS BIGINT) AS cap
        FROM customer""",
    "feed_lines": """
        SELECT k AS ord, k, n, name, seg, cap FROM feed_base
        UNION ALL
        SELECT k + 1000000000 AS ord, k, n, name, seg, CASE WHEN n = 2 THEN cap + 1 ELSE cap END AS cap
        FROM feed_base WHERE n IN (2, 12, 13)""",
    "feed": """
        SELECT ord, k,
               CASE n WHEN 0 THEN 'C.' || k WHEN 1 THEN 'C' || k || '/F' WHEN 3 THEN 'C' || k || 'F' ELSE 'C' || k END AS raw_symbol,
               CASE n WHEN 0 THEN 'C-' || k WHEN 1 THEN NULL WHEN 3 THEN 'C' || k || 'F' ELSE 'C' || k END AS ticker,
               CASE n WHEN 12 THEN '' ELSE name END AS company_name,
               CASE seg WHEN 'AUTOMOBILE' THEN 'NMS' WHEN 'BUILDING' THEN 'NYQ' WHEN 'FURNITURE' THEN 'ASE'
                        WHEN 'HOUSEHOLD' THEN 'NGM' ELSE 'PNK' END AS yahoo_exchange,
               CASE WHEN n IN (5, 6, 7, 8) OR cap <= 0 THEN NULL ELSE cap END AS market_cap,
               CASE n WHEN 14 THEN 'ETF' WHEN 15 THEN '' ELSE 'EQUITY' END AS quote_type
        FROM feed_lines""",
    "directory": """
        SELECT CASE n WHEN 0 THEN 'C-' || k WHEN 3 THEN 'C' || k || 'F' ELSE 'C' || k END AS ticker,
               name || CASE n WHEN 22 THEN ' American Depositary Shares' WHEN 23 THEN ' Preferred Stock'
                              WHEN 24 THEN ' Class A' ELSE ' Common Stock' END AS security_name,
               CASE seg WHEN 'BUILDING' THEN 'NYSE' WHEN 'FURNITURE' THEN 'NYSE American'
                        WHEN 'MACHINERY' THEN 'NYSE Arca' ELSE 'NASDAQ' END AS listing_exchange,
               n = 18 AS etf, n = 19 AS test_issue,
               CASE WHEN seg = 'AUTOMOBILE' THEN 'Q' WHEN seg = 'HOUSEHOLD' AND n = 17 THEN 'S'
                    WHEN seg = 'HOUSEHOLD' THEN 'G' END AS market_category,
               CASE WHEN seg NOT IN ('AUTOMOBILE', 'HOUSEHOLD') THEN NULL WHEN n = 20 THEN 'D' ELSE 'N' END AS financial_status
        FROM feed_base WHERE n <> 16""",
    "manual": "SELECT 'C' || k AS ticker FROM feed_base WHERE n = 21",
    "evaluated": """
        SELECT f.ord, coalesce(f.ticker, f.raw_symbol) AS ticker, f.company_name, d.security_name, f.yahoo_exchange,
               d.listing_exchange, f.market_cap, CASE f.quote_type WHEN '' THEN 'EQUITY' ELSE f.quote_type END AS quote_type,
               CASE WHEN f.ticker IS NULL THEN 'invalid_ticker'
                    WHEN f.market_cap IS NULL THEN 'invalid_market_cap'
                    WHEN f.yahoo_exchange = 'PNK' THEN 'exchange_not_allowed'
                    WHEN length(f.ticker) = 5 AND f.ticker LIKE '%F' THEN 'foreign_otc_suffix'
                    WHEN d.ticker IS NULL THEN 'not_in_symbol_directory' END AS early,
               CASE WHEN NOT coalesce(f.yahoo_exchange = CASE d.listing_exchange WHEN 'NYSE' THEN 'NYQ' WHEN 'NYSE American' THEN 'ASE'
                          WHEN 'NASDAQ' THEN CASE d.market_category WHEN 'Q' THEN 'NMS' WHEN 'G' THEN 'NGM' WHEN 'S' THEN 'NCM' END END, false)
                      THEN 'exchange_not_allowed'
                    WHEN d.etf THEN 'etf' WHEN d.test_issue THEN 'test_issue'
                    WHEN d.listing_exchange = 'NASDAQ' AND d.financial_status <> 'N' THEN 'ambiguous_security_type'
                    WHEN f.quote_type NOT IN ('', 'EQUITY') THEN 'non_common_security'
                    WHEN m.ticker IS NOT NULL THEN 'manual_exclusion'
                    WHEN d.security_name LIKE '%Depositary%' THEN 'adr_or_ads'
                    WHEN d.security_name LIKE '%Preferred%' THEN 'non_common_security'
                    WHEN d.security_name NOT LIKE '%Common Stock%' THEN 'ambiguous_security_type' END AS late
        FROM feed f LEFT JOIN directory d ON d.ticker = f.ticker LEFT JOIN manual m ON m.ticker = f.ticker""",
    "cascade": """
        SELECT ord, ticker,
               CASE WHEN early IS NULL AND late IS NULL AND company_name = '' THEN security_name ELSE company_name END AS company_name,
               CASE WHEN early IS NOT NULL THEN '' ELSE security_name END AS security_name, yahoo_exchange,
               CASE WHEN early IS NOT NULL THEN '' ELSE listing_exchange END AS listing_exchange,
               market_cap, quote_type, coalesce(early, late) AS exclusion_reason
        FROM evaluated""",
    "placed": """
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY market_cap DESC, ord) AS rn
        FROM cascade WHERE exclusion_reason IS NULL""",
    "candidates": "SELECT * FROM placed WHERE rn = 1",
    "excluded": """
        SELECT ticker, company_name, security_name, yahoo_exchange, listing_exchange, market_cap, exclusion_reason
        FROM cascade WHERE exclusion_reason IS NOT NULL
        UNION ALL
        SELECT ticker, company_name, security_name, yahoo_exchange, listing_exchange, market_cap, 'duplicate'
        FROM placed WHERE rn > 1""",
    "selected": """
        SELECT ticker, company_name, security_name, market_cap, yahoo_exchange, listing_exchange, quote_type,
               row_number() OVER (ORDER BY market_cap DESC, ticker) AS market_cap_rank
        FROM candidates ORDER BY market_cap DESC, ticker LIMIT 2000""",
    "top_accounts": """
        SELECT 'C' || c_custkey AS ticker, CAST(round(c_acctbal * 100) AS BIGINT) AS market_cap,
               row_number() OVER (ORDER BY CAST(round(c_acctbal * 100) AS BIGINT) DESC, 'C' || c_custkey) AS market_cap_rank
        FROM customer WHERE c_acctbal > 0.005 ORDER BY market_cap_rank LIMIT 2000""",
}


def sql(body: str) -> str:
    """Prefix a statement with the inputs it names, in dependency order."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                need(CTES[name])

    need(body)
    heads = [f"{n} AS ({CTES[n].strip()})" for n in CTES if n in needed]
    return (f"WITH {', '.join(heads)} " if heads else "") + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        _key("P", "l_partkey").alias("ticker"),
        F.col("l_extendedprice").alias("close"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("adj_close"),
        F.col("l_quantity").alias("volume"),
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_bars(spark, sf)
    # the footers tell how many rows there are
    tasks = max(spark.sparkContext.defaultParallelism, -(-raw.count() // ROWS_PER_TASK))
    return (
        raw.repartition(tasks, "date", "ticker")
        .groupBy("date", "ticker")
        .agg(F.max("close").alias("close"), F.max("adj_close").alias("adj_close"), F.max("volume").cast("bigint").alias("volume"))
    )


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """A raw feed with damaged values (missing dates, NaN, negative, infinite, fractional) and
    a part of its rows delivered twice."""
    lines = table(spark, sf, "lineitem")
    lines = lines.unionByName(lines.where("l_returnflag = 'A'"))
    n, price, quantity = F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_quantity")
    undiscounted, untaxed = F.col("l_discount") <= 0.005, F.col("l_tax") <= 0.005
    close = (
        F.when(undiscounted & (n == 2), float("nan"))
        .when(undiscounted & (n == 3), -1.0)
        .when(undiscounted & (n == 4), float("inf"))
        .otherwise(price)
    )
    volume = (
        F.when(untaxed & (n == 1), quantity + 0.5)
        .when(untaxed & (n == 2), -quantity)
        .when(untaxed & (n == 3), quantity + 0.0000000001)
        .otherwise(quantity)
    )
    return lines.select(
        F.when(~((n == 7) & (F.col("l_returnflag") == "R")), F.to_date("l_shipdate")).alias("date"),
        _key("P", "l_partkey").alias("ticker"),
        close.alias("close"),
        F.when((n == 5) & undiscounted, 0.0).otherwise(price * (1 - F.col("l_discount"))).alias("adj_close"),
        volume.alias("volume"),
    )


def dirty_text(spark: SparkSession, sf: str) -> DataFrame:
    """The same feed as text, with a zone on its dates and words for what is no number."""
    rows = dirty(spark, sf)

    def spelled(c: str) -> Column:
        return F.when(F.isnan(c), "n/a").when(F.col(c) == float("inf"), " inf ").otherwise(F.col(c).cast("string"))

    stamp = F.coalesce(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T23:30:00-05:00")), F.lit("bad date"))
    return rows.select(stamp.alias("date"), "ticker", *[spelled(c).alias(c) for c in ("close", "adj_close", "volume")])


def parsed(text: DataFrame) -> DataFrame:
    """A text feed as typed raw bars."""
    from barlake.functions.dates import calendar_date
    from barlake.functions.numbers import to_number

    return text.select(
        calendar_date(F.col("date")).alias("date"),
        "ticker",
        *[to_number(F.col(c)).alias(c) for c in ("close", "adj_close", "volume")],
    )


def old_bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).where(F.col("date") < F.lit(OLD_END))


def window_old(spark: SparkSession, sf: str) -> DataFrame:
    return old_bars(spark, sf).where(F.col("date") >= F.lit(dt.date(WINDOW_START.year, 1, 1)))


def new_bars(spark: SparkSession, sf: str) -> DataFrame:
    return (
        bars(spark, sf)
        .where(F.col("date").between(F.lit(WINDOW_START), F.lit(TARGET)) & (F.col("volume") != 7))
        .select("date", "ticker", (F.col("close") * 2).alias("close"), (F.col("adj_close") * 2).alias("adj_close"), (F.col("volume") + 1).alias("volume"))
    )


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), _key("P", "p_partkey").alias("ticker"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")

    weekdays = table(spark, sf, "orders").where(F.weekday("o_orderdate") < 5)
    return weekdays.select(day.alias("session")).distinct().select("session", (F.col("session").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(21))).alias("close_utc"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), _key("U", "c_custkey").alias("ticker"))


def user_bars(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.to_date("ts").alias("date"), _key("U", "user_id").alias("ticker"))
        .agg((F.max("value") + 1).alias("close"), (F.max("value") + 0.5).alias("adj_close"), F.count(F.lit(1)).alias("volume"))
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    failed = (F.col("event_type") == "error") & (F.col("value") > 40)
    success = (F.col("event_type") == "signup") & (F.col("value") > 45)
    return table(spark, sf, "events").select(
        _key("U", "user_id").alias("ticker"),
        F.col("event_id").alias("attempt_no"),
        F.when(failed, "failed").when(success, "success").otherwise("no_data").alias("outcome"),
        F.when(failed, F.concat(F.lit("E"), (F.col("event_id") % 7).cast("string"))).otherwise("").alias("error_type"),
        F.format_string("try  %d?key=%d&n=1", "event_id", "user_id").alias("message"),
    )


def _feed_lines(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"),
        F.col("c_nationkey").alias("n"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("seg"),
        F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cap"),
    )
    again = base.where(F.col("n").isin(2, 12, 13)).select(
        (F.col("k") + 1000000000).alias("ord"), "k", "n", "name", "seg", F.when(F.col("n") == 2, F.col("cap") + 1).otherwise(F.col("cap")).alias("cap")
    )
    return base.select(F.col("k").alias("ord"), "k", "n", "name", "seg", "cap").unionByName(again)


def _choose(c: Column, table_: dict, default: Column) -> Column:
    out = None
    for value, result in table_.items():
        result = result if isinstance(result, Column) else F.lit(result)
        out = F.when(c == value, result) if out is None else out.when(c == value, result)
    return out.otherwise(default)


def feed_json(spark: SparkSession, sf: str) -> DataFrame:
    """(ord, value): screener records as JSON text, with every spelling of a market cap."""
    n = F.col("n")
    k = F.col("k").cast("string")
    cap = F.col("cap").cast("string")
    symbol = _choose(
        n,
        {
            0: F.concat(F.lit("c."), k),
            1: F.concat(F.lit("C"), k, F.lit("/F")),
            2: F.concat(F.lit(" c"), k, F.lit("\\t")),
            3: F.concat(F.lit("C"), k, F.lit("F")),
        },
        F.concat(F.lit("C"), k),
    )
    value = F.format_string
    market_cap = _choose(
        n,
        {
            4: value('"marketCap":"%s.00"', cap),
            5: F.lit('"marketCap":"1e3"'),
            6: F.lit('"marketCap":true'),
            7: F.lit('"marketCap":null'),
            8: value('"marketCap":%s.5', cap),
            9: value('"marketCap":"-","lastclosemarketcap.lasttwelvemonths":%s', cap),
            10: value('"lastclosemarketcap":{"lasttwelvemonths":%se0}', cap),
            11: value('"marketCap":%s.0', cap),
        },
        value('"marketCap":%s', cap),
    )
    exchange = _choose(
        F.col("seg"), {"AUTOMOBILE": "NMS", "BUILDING": "NYQ", "FURNITURE": "ase", "HOUSEHOLD": " ngm "}, F.lit("PNK")
    )
    name = _choose(
        n, {12: F.lit('"longName":" ","shortName":7'), 13: value('"shortName":"%s"', F.col("name"))}, value('"longName":"%s"', F.col("name"))
    )
    kind = _choose(n, {14: ',"quoteType":"ETF"', 15: ""}, F.lit(',"quoteType":"equity"'))
    return _feed_lines(spark, sf).select(
        "ord", value('{"symbol":"%s",%s,"exchange":"%s",%s%s}', symbol, market_cap, exchange, name, kind).alias("value")
    )


def feed(spark: SparkSession, sf: str) -> DataFrame:
    return feed_json(spark, sf).select("ord", F.parse_json("value").alias("record"))


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """The directory's raw fields; n picks which customers are listed oddly."""
    rows = table(spark, sf, "customer").where("c_nationkey <> 16")
    n, seg = F.col("c_nationkey"), F.col("c_mktsegment")
    k = F.col("c_custkey").cast("string")
    return rows.select(
        _choose(n, {0: F.concat(F.lit("C."), k), 3: F.concat(F.lit("C"), k, F.lit("F"))}, F.concat(F.lit("C"), k)).alias("symbol"),
        F.concat(
            "c_name",
            _choose(n, {22: " American Depositary Shares", 23: " Preferred Stock", 24: " Class A"}, F.lit(" Common Stock")),
        ).alias("name"),
        seg.isin("AUTOMOBILE", "HOUSEHOLD").alias("first_layout"),
        _choose(seg, {"BUILDING": "N", "FURNITURE": "A"}, F.lit("P")).alias("exchange"),
        F.when(seg == "AUTOMOBILE", "Q").when(n == 17, "S").otherwise("G").alias("category"),
        F.when(n == 18, "Y").otherwise("N").alias("etf"),
        F.when(n == 19, "Y").otherwise("N").alias("test"),
        F.when(n == 20, "D").otherwise("N").alias("status"),
    )


def listed_a(spark: SparkSession, sf: str) -> DataFrame:
    return listing(spark, sf).where("first_layout").select(
        F.col("symbol").alias("Symbol"), F.col("name").alias("Security Name"), F.col("category").alias("Market Category"),
        F.col("test").alias("Test Issue"), F.col("status").alias("Financial Status"), F.col("etf").alias("ETF"),
    )


def listed_b(spark: SparkSession, sf: str) -> DataFrame:
    return listing(spark, sf).where("NOT first_layout").select(
        F.col("symbol").alias("ACT Symbol"), F.col("name").alias("Security Name"), F.col("exchange").alias("Exchange"),
        F.col("symbol").alias("CQS Symbol"), F.col("etf").alias("ETF"), F.col("test").alias("Test Issue"),
        F.when(F.col("exchange") == "A", F.concat("symbol", F.lit("="))).otherwise(F.col("symbol")).alias("NASDAQ Symbol"),
    )


def combined_directory(spark: SparkSession, sf: str) -> DataFrame:
    from barlake.sources.directory import combine, parse_listed_a, parse_listed_b

    return combine(parse_listed_a(listed_a(spark, sf)), parse_listed_b(listed_b(spark, sf)))


def directory(spark: SparkSession, sf: str) -> DataFrame:
    from barlake.sources.directory import directory as sound

    return sound(combined_directory(spark, sf))


def manual(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_nationkey = 21").select(_key("C", "c_custkey").alias("ticker"))


def top_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """A universe of fixed size from the customers: ticker, cap and rank."""
    from barlake.operators.universe import select_top

    rows = table(spark, sf, "customer").where("c_acctbal > 0.005")
    named = rows.select(_key("C", "c_custkey").alias("ticker"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("market_cap"))
    return select_top(named, UNIVERSE_SIZE)


_STORED: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf: str, label: str, write) -> str:
    """Folder of a derived dataset, written once per application and table folder."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _STORED:
        path = scratch(spark, label)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def stored_bars(spark: SparkSession, sf: str) -> str:
    """All bars as a year-partitioned dataset."""
    return once(spark, sf, "bars", lambda path: write_years(bars(spark, sf), path))


def forget() -> None:
    """Derive stored datasets anew on next use; a benchmark then times the whole job."""
    _STORED.clear()
