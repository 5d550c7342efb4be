"""Qualification, deduplication, ranking and reporting of a security universe."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.numbers import CAP_PATHS, NAME_PATHS, first_cap, first_name, text_of, variant_at
from barlake.functions.text import (
    ALLOWED_FEED_EXCHANGES,
    ALLOWED_LISTING_EXCHANGES,
    depositary_reason,
    expected_feed_exchange,
    is_foreign_otc,
    non_common_reason,
    normalize_ticker,
    strip,
)
from barlake.schema import AUDIT_SCHEMA, EXCLUDED_SCHEMA, MAX_CANDIDATES, PAGE_SIZE, UNIVERSE_SCHEMA, UNIVERSE_SIZE

# --- fixed values: exclusion reasons, in the order of the report ------------------------
REPORT_COUNTS = {
    "excluded_exchange_count": "exchange_not_allowed",
    "excluded_not_in_symbol_directory_count": "not_in_symbol_directory",
    "excluded_adr_count": "adr_or_ads",
    "excluded_foreign_otc_suffix_count": "foreign_otc_suffix",
    "excluded_etf_count": "etf",
    "excluded_test_issue_count": "test_issue",
    "excluded_non_common_security_count": "non_common_security",
    "excluded_ambiguous_security_type_count": "ambiguous_security_type",
    "manual_excluded_count": "manual_exclusion",
    "invalid_market_cap_count": "invalid_market_cap",
    "invalid_ticker_count": "invalid_ticker",
    "duplicate_count": "duplicate",
}
# ----------------------------------------------------------------------------------------


def screener_fields(records: DataFrame, record: str = "record", order: str = "ord") -> DataFrame:
    """The typed fields of VARIANT screener records; a record that is no object has none.

    Two layers: the record is navigated once per field, then the small values are judged. Spark
    keeps the layers apart because the second uses each value several times.
    """
    r = F.col(record)
    found = records.select(
        order,
        F.coalesce(F.schema_of_variant(r).startswith("OBJECT"), F.lit(False)).alias("is_object"),
        F.try_variant_get(r, "$.symbol", "string").alias("_raw"),
        variant_at(r, "$.symbol").alias("_symbol"),
        *[variant_at(r, p).alias(f"_name{i}") for i, p in enumerate(NAME_PATHS)],
        variant_at(r, "$.exchange").alias("_exchange"),
        *[variant_at(r, p).alias(f"_cap{i}") for i, p in enumerate(CAP_PATHS)],
        variant_at(r, "$.quoteType").alias("_type"),
    )

    def shouted(c: Column) -> Column:
        return F.coalesce(F.upper(strip(c)), F.lit(""))

    return found.select(
        order,
        "is_object",
        shouted(F.col("_raw")).alias("raw_symbol"),
        normalize_ticker(text_of(F.col("_symbol"))).alias("ticker"),
        first_name([F.col(f"_name{i}") for i in range(len(NAME_PATHS))]).alias("company_name"),
        shouted(text_of(F.col("_exchange"))).alias("yahoo_exchange"),
        first_cap([F.col(f"_cap{i}") for i in range(len(CAP_PATHS))]).alias("market_cap"),
        shouted(text_of(F.col("_type"))).alias("quote_type"),
    )


def screener_predicate(region: Column, exchange: Column, cap: Column) -> Column:
    return (region == "us") & exchange.isin(ALLOWED_FEED_EXCHANGES) & (cap > 0)


def _early_reason() -> Column:
    """Steps decided by the feed and by mere presence in the directory; evidence stays blank."""
    return (
        F.when(F.col("ticker").isNull(), "invalid_ticker")
        .when(F.col("market_cap").isNull(), "invalid_market_cap")
        .when(~F.col("yahoo_exchange").isin(ALLOWED_FEED_EXCHANGES), "exchange_not_allowed")
        .when(is_foreign_otc(F.col("ticker")), "foreign_otc_suffix")
        .when(F.col("security_name").isNull(), "not_in_symbol_directory")
    )


def _late_reason() -> Column:
    """Steps that judge the directory record."""
    expected = expected_feed_exchange(F.col("listing_exchange"), F.col("market_category"))
    agrees = F.col("listing_exchange").isin(ALLOWED_LISTING_EXCHANGES) & F.coalesce(
        F.col("yahoo_exchange") == expected, F.lit(False)
    )
    abnormal = (F.col("listing_exchange") == "NASDAQ") & ~F.col("financial_status").eqNullSafe(F.lit("N"))
    other_type = (F.col("quote_type") != "") & (F.col("quote_type") != "EQUITY")
    return (
        F.when(~agrees, "exchange_not_allowed")
        .when(F.col("etf"), "etf")
        .when(F.col("test_issue"), "test_issue")
        .when(abnormal, "ambiguous_security_type")
        .when(other_type, "non_common_security")
        .when(F.col("_manual").isNotNull(), "manual_exclusion")
        .otherwise(F.coalesce(depositary_reason(F.col("security_name")), non_common_reason(F.col("security_name"))))
    )


def evaluate(fields: DataFrame, directory: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Ordered exclusion cascade over feed left-join directory; first match wins, NULL means kept.

    The directory and the manual list are unique per ticker, so the join never multiplies feed
    rows. The manual list is marked in the directory, since it is asked only for listed tickers; that leaves
    one join of the feed, which Spark broadcasts only under its own size threshold and whose hot
    tickers its skew-join rule splits. Feed rows without a ticker get a key of their own, which
    nothing matches, so they spread evenly.
    """
    listed = directory.select(
        "ticker", "security_name", "listing_exchange", "etf", "test_issue", "market_category", "financial_status"
    )
    if manual is None:
        listed = listed.withColumn("_manual", F.lit(None).cast("boolean"))
    else:
        listed = listed.join(manual.select("ticker").distinct().withColumn("_manual", F.lit(True)), "ticker", "left")
    key = F.coalesce("ticker", F.concat(F.lit("\0"), F.col("ord").cast("string")))
    joined = fields.withColumn("_key", key).join(listed.withColumnRenamed("ticker", "_key"), "_key", "left").drop("_key")
    early = joined.withColumn("_early", _early_reason())
    reason = F.coalesce("_early", _late_reason())
    no_evidence = F.col("_early").isNotNull()
    name = F.coalesce(F.nullif(F.col("company_name"), F.lit("")), F.col("security_name"))
    staged = early.withColumn("exclusion_reason", reason)
    kept = F.col("exclusion_reason").isNull()
    return staged.select(
        "ord",
        F.coalesce("ticker", "raw_symbol").alias("ticker"),
        F.when(kept, name).otherwise(F.col("company_name")).alias("company_name"),
        F.when(no_evidence, "").otherwise(F.col("security_name")).alias("security_name"),
        "yahoo_exchange",
        F.when(no_evidence, "").otherwise(F.col("listing_exchange")).alias("listing_exchange"),
        "market_cap",
        F.when(F.col("quote_type") == "", "EQUITY").otherwise(F.col("quote_type")).alias("quote_type"),
        "exclusion_reason",
    )


#: More than there can be input positions, from 0; a cap times this is below 10^38.
POSITIONS = Decimal(10**18)
CANDIDATE_COLUMNS = ["company_name", "security_name", "yahoo_exchange", "listing_exchange", "quote_type"]


def best_per_ticker(kept: DataFrame) -> DataFrame:
    """Largest cap per ticker, the earlier row on ties.

    Cap and position are one number, so this is a hash aggregate of fixed width that reduces a ticker with any share
    of the rows map-side; the winners' texts are fetched by their unique positions.
    """
    lead = F.col("market_cap").cast("decimal(19,0)") * F.lit(POSITIONS) + (F.lit(POSITIONS - 1) - F.col("ord").cast("decimal(19,0)"))
    best = kept.groupBy("ticker").agg(F.max(lead.cast("decimal(38,0)")).alias("_lead"))
    won = best.select((F.lit(POSITIONS - 1) - F.col("_lead") % F.lit(POSITIONS)).cast("bigint").alias("ord"))
    return kept.join(won, "ord", "left_semi").select("ord", "ticker", "market_cap", *CANDIDATE_COLUMNS)


def split_candidates(evaluated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, excluded): losers of a ticker join the exclusions as duplicates.

    Losers are found by their unique input position, which spreads evenly whatever the tickers.
    """
    kept = evaluated.where("exclusion_reason IS NULL")
    candidates = best_per_ticker(kept)
    losers = kept.join(candidates.select("ord"), "ord", "left_anti").withColumn("exclusion_reason", F.lit("duplicate"))
    excluded = evaluated.where("exclusion_reason IS NOT NULL").unionByName(losers)
    return candidates, excluded.select(*EXCLUDED_SCHEMA.fieldNames())


def candidate_sort(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.desc("market_cap"), "ticker")


def exclusion_sort(excluded: DataFrame) -> DataFrame:
    return excluded.orderBy("exclusion_reason", "ticker", F.desc(F.coalesce("market_cap", F.lit(0))))


def select_top(candidates: DataFrame, size: int = UNIVERSE_SIZE) -> DataFrame:
    """The top `size` candidates with ranks 1..size.

    The top-k comes first, so the ranking window sees `size` rows and never the candidates.
    """
    top = candidate_sort(candidates).limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("market_cap"), "ticker")).cast("bigint")
    return top.withColumn("market_cap_rank", rank)


def universe_rows(selected: DataFrame) -> DataFrame:
    return selected.select(*UNIVERSE_SCHEMA.fieldNames())


def audit_rows(selected: DataFrame) -> DataFrame:
    return selected.withColumns({"etf": F.lit("N"), "test_issue": F.lit("N")}).select(*AUDIT_SCHEMA.fieldNames())


def reason_counts(excluded: DataFrame) -> DataFrame:
    return excluded.groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("n"))


def exchange_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("listing_exchange").agg(F.count(F.lit(1)).alias("n")).orderBy("listing_exchange")


def observed_tickers(evaluated: DataFrame) -> DataFrame:
    """Distinct non-blank tickers seen, valid or not."""
    seen = evaluated.select(F.nullif(F.col("ticker"), F.lit("")).alias("ticker")).where("ticker IS NOT NULL")
    return seen.distinct().agg(F.count(F.lit(1)).alias("unique_candidate_count"))


def suffix_counts(universe: DataFrame) -> DataFrame:
    five = F.length("ticker") == 5
    return universe.agg(
        F.count_if(five & F.col("ticker").endswith("F")).alias("five_char_ending_f_count"),
        F.count_if(five & F.col("ticker").endswith("Y")).alias("five_char_ending_y_count"),
    )


def cap_extremes(universe: DataFrame) -> DataFrame:
    return universe.agg(
        F.max("market_cap").alias("largest_market_cap"), F.min("market_cap").alias("smallest_market_cap")
    )


def build_report(
    records: DataFrame, directory_count: DataFrame, candidates: DataFrame, excluded: DataFrame, universe: DataFrame, audit: DataFrame, size: int
) -> DataFrame:
    """One report row; each part is one aggregate and one row, so the joins are of single rows."""
    by_reason = excluded.agg(
        *[F.count_if(F.col("exclusion_reason") == r).alias(n) for n, r in REPORT_COUNTS.items()]
    )
    final = universe.agg(
        F.count(F.lit(1)).alias("final_count"),
        F.max("market_cap").alias("largest_market_cap"),
        F.min("market_cap").alias("smallest_market_cap"),
        F.count_if((F.length("ticker") == 5) & F.col("ticker").endswith("F")).alias("five_char_ending_f_count"),
        F.count_if((F.length("ticker") == 5) & F.col("ticker").endswith("Y")).alias("five_char_ending_y_count"),
    )
    exchanges = audit.groupBy("listing_exchange").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("listing_exchange", "n")))).alias("exchange_counts")
    )
    parts = [
        records.agg(F.count(F.lit(1)).alias("raw_yfinance_candidate_count")),
        directory_count.agg(F.sum("raw_record_count").alias("symbol_directory_record_count")),
        candidates.agg(F.count(F.lit(1)).alias("validated_candidate_count")),
        final,
        by_reason,
        exchanges,
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.join(part, F.lit(True))
    return row.withColumns({"target_size": F.lit(size), "validation_passed": F.col("final_count") == size})


def page_stop(pages: DataFrame, qualifies: DataFrame, *, target: int, max_candidates: int = MAX_CANDIDATES, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row (stop, new_records): the page after which a paged read ends, if it does, and the new records so far.

    pages(page, ord, raw_count, is_new): all quotes in order, the page's size, and whether the
    record is new; qualifies(ord, ticker): records that pass the cascade. Reading stops after the page that completes the
    target, after a short page, and at a page
    without news. A ticker counts on the page that first has it. Every page before the stop has
    a new record, so max_candidates bounds the pages that can matter as well as the records.
    """
    capped = pages.where("is_new").orderBy("ord").limit(max_candidates)
    hits = capped.join(qualifies, "ord").groupBy("ticker").agg(F.min("page").alias("page"))
    found = hits.groupBy("page").agg(F.count(F.lit(1)).alias("_found"))
    sizes = (
        pages.groupBy("page")
        .agg(F.max("raw_count").alias("_raw"), F.count_if("is_new").alias("_new"))
        .orderBy("page")
        .limit(max_candidates + 1)
    )
    running = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enough = F.sum(F.coalesce("_found", F.lit(0))).over(running) >= target
    done = enough | (F.col("_raw") < page_size) | (F.col("_new") == 0)
    marked = sizes.join(found, "page", "left").withColumn("_done", done)
    return marked.agg(F.min(F.when(F.col("_done"), F.col("page"))).alias("stop"), F.coalesce(F.sum("_new"), F.lit(0)).alias("new_records"))


def cap_input(pages: DataFrame, qualifies: DataFrame, *, target: int, max_candidates: int = MAX_CANDIDATES, page_size: int = PAGE_SIZE) -> DataFrame:
    """Which records a paged read would keep: those up to `page_stop`, and no more than the input cap."""
    stop = page_stop(pages, qualifies, target=target, max_candidates=max_candidates, page_size=page_size).select("stop").scalar()
    capped = pages.where("is_new").orderBy("ord").limit(max_candidates)
    return capped.where(F.coalesce(F.col("page") <= stop, F.lit(True))).select("page", "ord")
