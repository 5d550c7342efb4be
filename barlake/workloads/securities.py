"""Directory, screener and universe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import quality as Q
from barlake.operators import universe as U
from barlake.plans.universe import qualify_candidates
from barlake.schema import PAGE_SIZE, UNIVERSE_SIZE
from barlake.session import cut
from barlake.sinks.reports import write_csv
from barlake.sources import directory as D
from barlake.sources import universe as SU
from barlake.workloads import inputs as I
from barlake.operators.ordering import with_position
from barlake.workloads.registry import query

FINAL = "ticker, company_name, security_name, market_cap, market_cap_rank, yahoo_exchange, listing_exchange"


def evaluated(spark, sf):
    return U.evaluate(U.screener_fields(I.feed(spark, sf)), I.directory(spark, sf), I.manual(spark, sf))


def split(spark, sf):
    q = qualify_candidates(I.feed(spark, sf), I.directory(spark, sf), I.manual(spark, sf), materialize=True)
    return q.candidates, q.excluded


def selected(spark, sf):
    q = qualify_candidates(I.feed(spark, sf), I.directory(spark, sf), I.manual(spark, sf))
    return U.select_top(q.candidates)


def pipe_rows(spark, sf, label, rows, names):
    """Write the directory as pipe-separated files with footer and blank lines, then scan them."""

    def write(path):
        padded = rows.select(*[F.concat(F.lit(" "), F.col(f"`{n}`"), F.lit(" ")).alias(n) for n in names])
        extra = spark.createDataFrame([("File Creation Time: 0804200121:31",), (" ",)], "first string")
        tail = extra.select(F.col("first").alias(names[0]), *[F.lit(None).cast("string").alias(n) for n in names[1:]])
        padded.unionByName(tail).write.option("sep", "|").option("header", "true").csv(path)

    return D.read_pipe(spark, I.once(spark, sf, label, write), names)


def scanned_a(spark, sf):
    return pipe_rows(spark, sf, "listed-a", I.listed_a(spark, sf), D.LISTED_A_COLUMNS)


def scanned_b(spark, sf):
    return pipe_rows(spark, sf, "listed-b", I.listed_b(spark, sf), D.LISTED_B_COLUMNS)


@query("s1_universe_scan", "SELECT min(c_custkey) AS ord, 'N-' || c_nationkey AS ticker FROM customer GROUP BY c_nationkey")
def s1(spark, sf):
    def write(path):
        rows = I.table(spark, sf, "customer").select(
            F.concat(F.lit(" n."), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("ticker"),
            F.col("c_name").alias("company_name"),
            F.col("c_custkey").alias("market_cap_rank"),
        )
        blank = rows.select(F.lit(" ").alias("ticker"), "company_name", "market_cap_rank")
        rows.unionByName(blank).write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)

    return SU.load_universe(spark, I.once(spark, sf, "universe-csv", write))


@query(
    "s1_universe_unranked",
    """SELECT 'C-' || c_mktsegment AS ticker, min(pos) AS ord FROM (
         SELECT c_mktsegment, row_number() OVER (ORDER BY c_custkey DESC) AS pos FROM customer) GROUP BY c_mktsegment""",
)
def s1_unranked(spark, sf):
    """A file in which one row has no rank keeps the order of its lines."""

    def write(path):
        rows = I.table(spark, sf, "customer").orderBy(F.desc("c_custkey")).select(
            F.concat(F.lit("C-"), "c_mktsegment").alias("ticker"),
            F.when(F.col("c_custkey") > 1, F.col("c_custkey")).alias("market_cap_rank"),
        )
        rows.coalesce(1).write.option("header", "true").csv(path)

    return SU.load_universe(spark, I.once(spark, sf, "universe-unranked", write)).select("ticker", "ord")


@query(
    "s2_pipe_directory_scan",
    "SELECT CASE n WHEN 0 THEN 'C.' || k WHEN 3 THEN 'C' || k || 'F' ELSE 'C' || k END AS symbol, "
    "CASE n WHEN 20 THEN 'D' ELSE 'N' END AS status FROM feed_base WHERE n <> 16 AND seg IN ('AUTOMOBILE', 'HOUSEHOLD')",
)
def s2(spark, sf):
    return scanned_a(spark, sf).select(F.col("Symbol").alias("symbol"), F.col("Financial Status").alias("status"))


@query(
    "s3_listed_directory_a",
    "SELECT *, CAST(NULL AS VARCHAR) AS problem FROM directory WHERE listing_exchange = 'NASDAQ'",
)
def s3(spark, sf):
    return D.parse_listed_a(scanned_a(spark, sf)).drop("raw_symbol")


@query(
    "s4_listed_directory_b",
    """SELECT *, replace(ticker, '-', '.') AS raw_symbol
       FROM directory WHERE listing_exchange <> 'NASDAQ'""",
)
def s4(spark, sf):
    return D.parse_listed_b(scanned_b(spark, sf)).drop("problem")


@query("u2_directory_union", "SELECT * FROM directory")
def u2(spark, sf):
    """Both layouts, with every record of the second layout delivered twice."""
    second = D.parse_listed_b(I.listed_b(spark, sf))
    combined = D.combine(D.parse_listed_a(I.listed_a(spark, sf)), second, second)
    return D.directory(combined).drop("raw_symbol")


@query(
    "u2_directory_conflicts",
    "SELECT 'C' || k AS ticker, CAST(2 AS BIGINT) AS records FROM feed_base WHERE n NOT IN (0, 3, 16) AND seg = 'BUILDING'",
)
def u2_conflicts(spark, sf):
    second = D.parse_listed_b(I.listed_b(spark, sf))
    other = second.withColumn("security_name", F.concat("security_name", F.lit("."))).where(
        (F.col("listing_exchange") == "NYSE") & (F.col("raw_symbol") == F.col("ticker")) & ~F.col("ticker").endswith("F")
    )
    return D.conflicting_tickers(D.combine(second, other))


def full_pages(spark, sf):
    """The feed in full pages, but for the last."""
    placed = with_position(I.feed_json(spark, sf), [F.col("ord")])
    return _pages_of(placed.withColumn("page", F.floor((F.col("position") - 1) / PAGE_SIZE)))


def pages(spark, sf):
    """Screener pages as JSON text: consecutive runs of at most one page of records."""
    return _pages_of(I.feed_json(spark, sf).withColumn("page", F.floor(F.col("ord") / PAGE_SIZE)))


def _pages_of(rows):
    listed = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("q"))  # at most PAGE_SIZE
    body = F.concat(F.lit('{"count": 0, "quotes": ['), F.array_join(F.transform("q", lambda r: r["value"]), ", "), F.lit("]}"))
    return listed.select("page", body.alias("value"))


@query(
    "s5_screener_pages",
    """SELECT f.ord // 250 AS page, CAST(row_number() OVER (PARTITION BY f.ord // 250 ORDER BY f.ord) - 1 AS BIGINT) AS pos,
         count(*) OVER (PARTITION BY f.ord // 250) AS raw_count, ticker, market_cap FROM feed f""",
)
def s5(spark, sf):
    quotes = SU.parse_pages(pages(spark, sf))
    fields = U.screener_fields(quotes.withColumn("ord", F.struct("page", "pos", "raw_count")))
    return fields.select(
        "ord.page", F.col("ord.pos").cast("bigint").alias("pos"), "ord.raw_count", "ticker", "market_cap"
    )


@query("s6_manual_exclusions", "SELECT ticker FROM manual")
def s6(spark, sf):
    def write(path):
        named = I.table(spark, sf, "customer").where("c_nationkey = 21").select(
            F.concat(F.lit(" c"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("value")
        )
        notes = I.table(spark, sf, "nation").select(F.concat(F.lit("# "), "n_name").alias("value"))
        blank = I.table(spark, sf, "region").select(F.lit("  ").alias("value"))
        named.unionByName(notes).unionByName(blank).write.text(path)

    return SU.manual_exclusions(spark, I.once(spark, sf, "manual", write))


@query("s13_universe_csv", "SELECT ticker, company_name, market_cap, market_cap_rank FROM selected")
def s13(spark, sf):
    path = I.once(
        spark, sf, "universe-final",
        lambda p: write_csv(U.universe_rows(selected(spark, sf)), p, ["market_cap_rank"]),
    )
    return SU.read_universe(spark, path)


@query("s13_audit_csv", f"SELECT {FINAL}, 'N' AS etf, 'N' AS test_issue, quote_type FROM selected")
def s13_audit(spark, sf):
    path = I.once(
        spark, sf, "audit-final", lambda p: write_csv(U.audit_rows(selected(spark, sf)), p, ["market_cap_rank"])
    )
    return SU.read_audit(spark, path)


@query(
    "j1_screener_directory_join",
    "SELECT f.ord, f.ticker, d.listing_exchange, d.security_name FROM feed f LEFT JOIN directory d ON d.ticker = f.ticker",
)
def j1(spark, sf):
    fields = U.screener_fields(I.feed(spark, sf)).select("ord", "ticker")
    return fields.join(I.directory(spark, sf).select("ticker", "listing_exchange", "security_name"), "ticker", "left")


@query("j2_manual_membership", "SELECT ord, f.ticker FROM feed f WHERE f.ticker IN (SELECT ticker FROM manual)")
def j2(spark, sf):
    fields = U.screener_fields(I.feed(spark, sf)).select("ord", "ticker")
    return fields.join(I.manual(spark, sf), "ticker", "left_semi")


@query("w3_best_candidate", "SELECT ord, ticker, market_cap, company_name FROM candidates")
def w3(spark, sf):
    return U.best_per_ticker(evaluated(spark, sf).where("exclusion_reason IS NULL")).select("ord", "ticker", "market_cap", "company_name")


@query("w3_duplicate_exclusions", "SELECT ticker, market_cap FROM excluded WHERE exclusion_reason = 'duplicate'")
def w3_losers(spark, sf):
    return split(spark, sf)[1].where("exclusion_reason = 'duplicate'").select("ticker", "market_cap")


@query("w4_rank", f"SELECT {FINAL}, quote_type FROM selected")
def w4(spark, sf):
    return selected(spark, sf).drop("ord")


@query("o2_candidate_sort", "SELECT ticker, market_cap FROM candidates ORDER BY market_cap DESC, ticker")
def o2(spark, sf):
    kept = evaluated(spark, sf).where("exclusion_reason IS NULL")
    return U.candidate_sort(U.best_per_ticker(kept)).select("ticker", "market_cap")


@query("o3_exclusion_sort", "SELECT * FROM excluded ORDER BY exclusion_reason, ticker, coalesce(market_cap, 0) DESC")
def o3(spark, sf):
    return U.exclusion_sort(split(spark, sf)[1])


@query("o4_top_k", "SELECT ticker, market_cap, market_cap_rank FROM top_accounts")
def o4(spark, sf):
    return I.top_accounts(spark, sf).select("ticker", "market_cap", "market_cap_rank")


@query(
    "o5_error_sample",
    """SELECT 'unexpected_ticker' AS rule, count(*) AS n, (SELECT string_agg(ticker, ',' ORDER BY ticker) FROM
         (SELECT ticker FROM feed f WHERE ticker IS NOT NULL AND ticker NOT IN (SELECT ticker FROM directory) GROUP BY ticker ORDER BY ticker LIMIT 10)) AS sample
       FROM (SELECT DISTINCT ticker FROM feed f WHERE ticker IS NOT NULL AND ticker NOT IN (SELECT ticker FROM directory))""",
)
def o5(spark, sf):
    fields = U.screener_fields(I.feed(spark, sf)).where("ticker IS NOT NULL")
    return Q.unexpected_tickers(fields, I.directory(spark, sf))


@query(
    "o6_input_cap",
    """SELECT page, ord FROM (SELECT ord // 250 AS page, ord, row_number() OVER (ORDER BY ord) AS rn FROM feed f) r
       WHERE rn <= 5000 AND page <= coalesce((SELECT min(page) FROM (
           SELECT p.page, p.raw_count, sum(coalesce(h.found, 0)) OVER (ORDER BY p.page) AS running
           FROM (SELECT ord // 250 AS page, count(*) AS raw_count FROM feed f GROUP BY 1) p
           LEFT JOIN (SELECT page, count(*) AS found FROM (
               SELECT c.ticker, min(r2.ord // 250) AS page FROM cascade c
               JOIN (SELECT ord, row_number() OVER (ORDER BY ord) AS rn FROM feed f) r2 ON r2.ord = c.ord
               WHERE r2.rn <= 5000 AND c.exclusion_reason IS NULL GROUP BY c.ticker) GROUP BY page) h ON h.page = p.page)
         WHERE running >= 400 OR raw_count < 250), 9000000000000)""",
)
def o6(spark, sf):
    rows = cut(evaluated(spark, sf).select("ord", "ticker", "exclusion_reason"))
    per_page = rows.select("ord", F.floor(F.col("ord") / PAGE_SIZE).alias("page"), F.lit(True).alias("is_new"))
    sizes = per_page.groupBy("page").agg(F.count(F.lit(1)).alias("raw_count"))
    kept = rows.where("exclusion_reason IS NULL").select("ord", "ticker")
    return U.cap_input(per_page.join(sizes, "page"), kept, target=400)


@query("a5_reason_counts", "SELECT exclusion_reason, count(*) AS n FROM excluded GROUP BY exclusion_reason")
def a5(spark, sf):
    return U.reason_counts(split(spark, sf)[1])


@query("a6_exchange_counts", "SELECT listing_exchange, count(*) AS n FROM selected GROUP BY listing_exchange")
def a6(spark, sf):
    return U.exchange_counts(U.audit_rows(selected(spark, sf)))


@query(
    "a9_suffix_counts",
    """SELECT count(*) FILTER (WHERE length(ticker) = 5 AND ticker LIKE '%F') AS five_char_ending_f_count,
              count(*) FILTER (WHERE length(ticker) = 5 AND ticker LIKE '%Y') AS five_char_ending_y_count FROM feed WHERE ticker IS NOT NULL""",
)
def a9(spark, sf):
    return U.suffix_counts(U.screener_fields(I.feed(spark, sf)))


@query("a13_observed_tickers", "SELECT count(DISTINCT nullif(ticker, '')) AS unique_candidate_count FROM cascade")
def a13(spark, sf):
    return U.observed_tickers(evaluated(spark, sf))


@query("a14_cap_extremes", "SELECT max(market_cap) AS largest_market_cap, min(market_cap) AS smallest_market_cap FROM selected")
def a14(spark, sf):
    return U.cap_extremes(selected(spark, sf))


@query(
    "a17_build_report",
    "SELECT (SELECT count(*) FROM feed) AS raw_yfinance_candidate_count, (SELECT count(*) FROM directory) AS symbol_directory_record_count, "
    "(SELECT count(*) FROM candidates) AS validated_candidate_count, (SELECT count(*) FROM selected) AS final_count, "
    "(SELECT max(market_cap) FROM selected) AS largest_market_cap, (SELECT min(market_cap) FROM selected) AS smallest_market_cap, "
    + ", ".join(f"(SELECT count(*) FROM excluded WHERE exclusion_reason = '{r}') AS {n}" for n, r in U.REPORT_COUNTS.items()),
)
def a17(spark, sf):
    candidates, excluded = split(spark, sf)
    top = cut(U.select_top(candidates))
    combined = I.combined_directory(spark, sf)
    report = U.build_report(
        I.feed(spark, sf), D.raw_record_count(combined), candidates, excluded, U.universe_rows(top), U.audit_rows(top), UNIVERSE_SIZE
    )
    return report.drop("exchange_counts", "target_size", "validation_passed", "five_char_ending_f_count", "five_char_ending_y_count")


def shifted(spark, sf):
    """A universe with defects: ranks moved, names blanked, a cap negated, by rule over all rows."""
    u = U.universe_rows(selected(spark, sf))
    return u.select(
        F.when(F.col("market_cap") % 5 == 0, F.lower("ticker")).otherwise(F.col("ticker")).alias("ticker"),
        F.when(F.col("market_cap") % 7 == 0, " ").otherwise(F.col("company_name")).alias("company_name"),
        F.when(F.col("market_cap") % 11 == 0, -F.col("market_cap")).otherwise(F.col("market_cap")).alias("market_cap"),
        "market_cap_rank",
    )


SHIFTED = """(SELECT CASE WHEN market_cap % 5 = 0 THEN lower(ticker) ELSE ticker END AS ticker,
    CASE WHEN market_cap % 7 = 0 THEN ' ' ELSE company_name END AS company_name,
    CASE WHEN market_cap % 11 = 0 THEN -market_cap ELSE market_cap END AS market_cap, market_cap_rank FROM selected)"""


@query(
    "w9_rank_order_breaks",
    f"""SELECT market_cap_rank, ticker FROM (SELECT *, lead(market_cap) OVER (ORDER BY market_cap_rank) AS nc,
         lead(ticker) OVER (ORDER BY market_cap_rank) AS nt FROM {SHIFTED})
       WHERE nc IS NOT NULL AND NOT (market_cap > nc OR (market_cap = nc AND ticker <= nt))""",
)
def w9(spark, sf):
    return Q.rank_breaks(cut(shifted(spark, sf))).select("market_cap_rank", "ticker")


@query(
    "v6_universe_gate",
    f"""SELECT * FROM (SELECT unnest([
          {{'rule': 'ticker_not_normalised', 'n': count(*) FILTER (WHERE ticker <> upper(ticker))}},
          {{'rule': 'missing_company_name', 'n': count(*) FILTER (WHERE trim(company_name) = '')}},
          {{'rule': 'market_cap_not_positive', 'n': count(*) FILTER (WHERE market_cap <= 0)}},
          {{'rule': 'row_count', 'n': CASE WHEN count(*) <> 2000 THEN 1 ELSE 0 END}},
          {{'rule': 'rank_order', 'n': (SELECT count(*) FROM (SELECT *, lead(market_cap) OVER (ORDER BY market_cap_rank) AS nc,
             lead(ticker) OVER (ORDER BY market_cap_rank) AS nt FROM {SHIFTED}) WHERE nc IS NOT NULL
             AND NOT (market_cap > nc OR (market_cap = nc AND ticker <= nt)))}}], recursive := true) FROM {SHIFTED}) WHERE n > 0""",
)
def v6(spark, sf):
    return Q.universe_violations(cut(shifted(spark, sf)), UNIVERSE_SIZE).select("rule", "n")


def doubted(top):
    """Audit rows with defects by rule over all rows."""
    audit = U.audit_rows(top)
    cap = F.col("market_cap")
    return audit.withColumns(
        {
            "yahoo_exchange": F.when(cap % 5 == 0, "PNK").otherwise(F.col("yahoo_exchange")),
            "etf": F.when(cap % 7 == 0, "Y").otherwise(F.col("etf")),
            "security_name": F.when(cap % 11 == 0, "Some ADR").otherwise(F.col("security_name")),
            "quote_type": F.when(cap % 13 == 0, "fund").otherwise(F.lower("quote_type")),
            "company_name": F.when(cap % 17 == 0, "?").otherwise(F.col("company_name")),
        }
    )


@query(
    "v7_audit_gate",
    """SELECT * FROM (SELECT unnest([
          {'rule': 'audit_mismatch', 'n': count(*) FILTER (WHERE market_cap % 17 = 0)},
          {'rule': 'feed_exchange', 'n': count(*) FILTER (WHERE market_cap % 5 = 0)},
          {'rule': 'etf_or_test_issue', 'n': count(*) FILTER (WHERE market_cap % 7 = 0)},
          {'rule': 'depositary', 'n': count(*) FILTER (WHERE market_cap % 11 = 0)},
          {'rule': 'not_common', 'n': count(*) FILTER (WHERE market_cap % 11 = 0)},
          {'rule': 'not_equity', 'n': count(*) FILTER (WHERE market_cap % 13 = 0)}], recursive := true) FROM selected) WHERE n > 0""",
)
def v7(spark, sf):
    top = cut(selected(spark, sf))
    return Q.audit_violations(top, doubted(top), I.manual(spark, sf)).select("rule", "n")


@query("j11_audit_mismatches", "SELECT market_cap_rank, ticker AS universe_ticker, ticker AS audit_ticker FROM selected WHERE market_cap % 17 = 0")
def j11(spark, sf):
    top = cut(selected(spark, sf))
    return Q.audit_mismatches(top, doubted(top))
