"""Data-quality gates as violations tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.numbers import in_range, positive_finite
from barlake.functions.text import (
    ALLOWED_FEED_EXCHANGES,
    ALLOWED_LISTING_EXCHANGES,
    depositary_reason,
    is_foreign_otc,
    non_common_reason,
    normalize_ticker,
    strip,
)
from barlake.operators.bars import repeated_keys
from barlake.operators.gates import counted, gather, listed, sampled
from barlake.schema import BAR_COLUMNS, BAR_SCHEMA, MINIMUM_TARGET_COVERAGE


def value_rules(start, end) -> dict[str, Column]:
    """Row rules of a stored bar. NULLs are counted once, by their own rule."""
    def known(c: str, rule: Column) -> Column:
        return F.col(c).isNotNull() & ~rule

    return {
        "null_value": F.greatest(*[F.col(c).isNull() for c in BAR_COLUMNS]),
        "close_not_positive_finite": known("close", positive_finite(F.col("close"))),
        "adj_close_not_positive_finite": known("adj_close", positive_finite(F.col("adj_close"))),
        "negative_volume": known("volume", F.col("volume") >= 0),
        "date_out_of_range": known("date", in_range(F.col("date"), start, end)),
        "empty_ticker": known("ticker", F.col("ticker") != ""),
    }


def typed_violations(df: DataFrame, start, end, allowed: DataFrame | None = None) -> DataFrame:
    """Schema, NULL, positivity, range and membership; one aggregate plus one anti join."""
    found = [counted(df, value_rules(start, end)), schema_violations(df)]
    if allowed is not None:
        found.append(unexpected_tickers(df, allowed))
    return gather(*found)


def bar_violations(df: DataFrame, start, end, allowed: DataFrame | None = None) -> DataFrame:
    """All rules of a normalised bar table that do not depend on file order."""
    return gather(typed_violations(df, start, end, allowed), key_violations(df))


def schema_violations(df: DataFrame) -> DataFrame:
    """Names and types only: Parquet columns read back as nullable, so NULLs are counted instead."""
    expected = [(f.name, f.dataType.simpleString()) for f in BAR_SCHEMA]
    actual = [(n, t) for n, t in df.dtypes if n != "year"]
    wrong = 0 if actual == expected else 1
    shown = ", ".join(f"{n} {t}" for n, t in actual)
    spark = df.sparkSession
    return spark.range(wrong).select(F.lit("schema").alias("rule"), F.lit(1).cast("bigint").alias("n"), F.lit(shown).alias("sample"))


def key_violations(df: DataFrame) -> DataFrame:
    return sampled(repeated_keys(df), "duplicate_key", F.concat_ws(" ", F.col("date").cast("string"), "ticker"))


def unexpected_tickers(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """Tickers outside the allowed table. Distinct first, so the join sees each ticker once."""
    outside = df.select("ticker").distinct().join(allowed.select("ticker"), "ticker", "left_anti")
    return listed(outside, "unexpected_ticker", F.col("ticker"))


def order_violations(runs: DataFrame) -> DataFrame:
    """From summaries of blocks of rows (sources.files.key_runs): stored order and repeats per file.

    A file's blocks follow each other; a boundary is wrong when the next block starts
    below, or at, the last key of the one before.
    """
    nxt = Window.partitionBy("file").orderBy("block")
    edge = runs.withColumn("_before", F.lag("last_key").over(nxt))
    per_file = edge.groupBy("file").agg(
        (F.sum("descents") + F.count_if(F.col("first_key") < F.col("_before"))).alias("descents"),
        (F.sum("repeats") + F.count_if(F.col("first_key") == F.col("_before"))).alias("repeats"),
    )
    return gather(
        sampled(per_file.where("descents > 0"), "file_not_sorted", F.col("file")),
        sampled(per_file.where("repeats > 0"), "file_repeats_key", F.col("file")),
    )


def codec_violations(footers: DataFrame) -> DataFrame:
    """Files of another codec than zstd, and files of which no codec is known."""
    return sampled(footers.where("coalesce(codec, '') <> 'ZSTD'"), "not_zstd", F.col("file"))


def overlapping_years(runs: DataFrame) -> DataFrame:
    """Calendar years in which two files' key ranges touch, from the run summaries alone.

    A file counts in every year its keys span, whichever directory it lies in. The window runs over the file
    list of one year.
    """
    files = runs.groupBy("file").agg(
        F.min("low_key").alias("lo"), F.max("high_key").alias("hi")
    )
    year_of = {c: F.year(F.date_from_unix_date(F.col(f"{c}.day"))) for c in ("lo", "hi")}
    span = F.sequence(year_of["lo"], year_of["hi"])
    earlier = Window.partitionBy("date_year").orderBy("lo", "file").rowsBetween(Window.unboundedPreceding, -1)
    marked = files.withColumn("date_year", F.explode(span)).withColumn("_reach", F.max("hi").over(earlier))
    return marked.where(F.col("lo") <= F.col("_reach")).select("date_year").distinct()


def cross_file_repeats(stored: DataFrame, runs: DataFrame) -> DataFrame:
    """Keys stored in more than one file. Files of disjoint ranges cannot share a key, so only
    years with overlapping files are shuffled; as year-partitioned writes make no overlaps, the
    usual cost is none."""
    years = sorted(r.date_year for r in overlapping_years(runs).collect())  # calendar years
    suspect = stored.where(F.year("date").isin(years) if years else F.lit(False))
    return sampled(repeated_keys(suspect), "duplicate_key", F.concat_ws(" ", F.col("date").cast("string"), "ticker"))


def stored_rules(start, end) -> dict[str, Column]:
    """Row rules of a stored partition: a bar's own, and that it lies in its year's folder."""
    return {**value_rules(start, end), "wrong_year": F.year("date") != F.col("year")}


def stored_violations(
    stored: DataFrame, runs: DataFrame, footers: DataFrame, start, end, allowed: DataFrame | None = None, observed: DataFrame | None = None
) -> DataFrame:
    """A stored partition: typed rules, year of the directory, order, uniqueness and codec.

    One aggregate over the rows covers the value rules, unless the write has counted them (`observed`, from
    sinks.bars.observed_violations); order and uniqueness come from the run summaries.
    """
    found = [
        counted(stored, stored_rules(start, end)) if observed is None else observed,
        schema_violations(stored),
        order_violations(runs),
        codec_violations(footers),
        cross_file_repeats(stored, runs),
    ]
    if allowed is not None:
        found.append(unexpected_tickers(stored, allowed))
    return gather(*found)


def count_mismatches(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Full outer comparison of (year, row_count) tables."""
    a = actual.select("year", F.col("row_count").alias("_a"))
    e = expected.select("year", F.col("row_count").alias("_e"))
    both = a.join(e, "year", "full").where(~F.col("_a").eqNullSafe(F.col("_e")))
    label = F.format_string("%s:%s<>%s", F.col("year").cast("string"), F.col("_a").cast("string"), F.col("_e").cast("string"))
    return sampled(both, "partition_count", label)


def dataset_violations(stored: DataFrame, runs, footers, start, end, allowed: DataFrame, expected_counts: DataFrame) -> DataFrame:
    """The whole dataset: stored rules, expected counts per year and in total, known tickers."""
    actual = stored.groupBy("year").agg(F.count(F.lit(1)).alias("row_count"))
    total = actual.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("a")).join(
        expected_counts.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("e")), F.lit(True)
    )
    return gather(
        stored_violations(stored, runs, footers, start, end, allowed),
        count_mismatches(actual, expected_counts),
        counted(total, {"total_count": F.col("a") != F.col("e")}),
    )


def rank_breaks(universe: DataFrame) -> DataFrame:
    """Neighbours by rank that are not in (cap desc, ticker asc) order, via an equi join on rank."""
    here = universe.select("market_cap_rank", "ticker", "market_cap")
    after = universe.select(
        (F.col("market_cap_rank") - 1).alias("market_cap_rank"),
        F.col("ticker").alias("_next_ticker"),
        F.col("market_cap").alias("_next_cap"),
    )
    ordered = (F.col("market_cap") > F.col("_next_cap")) | (
        (F.col("market_cap") == F.col("_next_cap")) & (F.col("ticker") <= F.col("_next_ticker"))
    )
    return here.join(after, "market_cap_rank").where(~ordered)


def universe_violations(universe: DataFrame, size: int) -> DataFrame:
    """Exact size, normalised unique tickers, names, positive caps, ranks 1..N in order."""
    t = F.col("ticker")
    rows = counted(
        universe,
        {
            "ticker_not_normalised": ~normalize_ticker(t).eqNullSafe(t),
            "foreign_otc_suffix": is_foreign_otc(t),
            "missing_company_name": strip(F.col("company_name")) == "",
            "market_cap_not_positive": F.col("market_cap") <= 0,
            "rank_out_of_range": ~F.col("market_cap_rank").between(1, size),
        },
    )
    totals = universe.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("ticker").alias("tickers"),
        F.count_distinct("market_cap_rank").alias("ranks"),
    )
    return gather(
        rows,
        counted(
            totals,
            {
                "row_count": F.col("n") != size,
                "duplicate_ticker": F.col("tickers") != F.col("n"),
                "rank_not_continuous": F.col("ranks") != F.col("n"),
            },
        ),
        sampled(rank_breaks(universe), "rank_order", F.col("ticker")),
    )


def audit_mismatches(universe: DataFrame, audit: DataFrame) -> DataFrame:
    """Pairs by rank whose shared fields differ, or that lack a partner."""
    fields = ["ticker", "company_name", "market_cap"]
    u = universe.select("market_cap_rank", F.struct(*fields).alias("_u"), F.col("ticker").alias("universe_ticker"))
    a = audit.select("market_cap_rank", F.struct(*fields).alias("_a"), F.col("ticker").alias("audit_ticker"))
    return (
        u.join(a, "market_cap_rank", "full")
        .where(~F.col("_u").eqNullSafe(F.col("_a")))
        .select("market_cap_rank", "universe_ticker", "audit_ticker")
    )


def audit_violations(universe: DataFrame, audit: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Source-backed evidence of every selected row."""
    found = [
        sampled(audit_mismatches(universe, audit), "audit_mismatch", F.col("market_cap_rank")),
        counted(
            audit,
            {
                "feed_exchange": ~F.col("yahoo_exchange").isin(ALLOWED_FEED_EXCHANGES),
                "listing_exchange": ~F.col("listing_exchange").isin(ALLOWED_LISTING_EXCHANGES),
                "etf_or_test_issue": (F.col("etf") != "N") | (F.col("test_issue") != "N"),
                "not_equity": F.upper("quote_type") != "EQUITY",
                "depositary": depositary_reason(F.col("security_name")).isNotNull(),
                "not_common": non_common_reason(F.col("security_name")).isNotNull(),
            },
        ),
    ]
    if manual is not None:
        banned = audit.join(manual.select("ticker"), "ticker", "left_semi")
        found.append(sampled(banned, "manually_excluded", F.col("ticker")))
    return gather(*found)


def coverage_gate(ratio: DataFrame, minimum: float = MINIMUM_TARGET_COVERAGE, allow_partial: bool = False) -> DataFrame:
    if not 0 <= minimum <= 1:
        raise ValueError("minimum coverage must be between zero and one")
    short = F.lit(False) if allow_partial else F.col("coverage_ratio") < minimum
    return counted(ratio, {"target_coverage": short})


def key_set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that are not on both sides exactly once."""
    counts = (
        left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
        .unionByName(right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        .groupBy(key)
        .agg(F.sum("_l").alias("left_count"), F.sum("_r").alias("right_count"))
    )
    return counts.where("left_count <> 1 OR right_count <> 1")


def coverage_row_violations(coverage: DataFrame, universe: DataFrame) -> DataFrame:
    """Acceptance: coverage is exactly the universe, every ticker complete and successful."""
    return gather(
        sampled(key_set_differences(coverage, universe, "ticker"), "coverage_not_universe", F.col("ticker")),
        counted(
            coverage,
            {
                "status_not_success": F.col("status") != "success",
                "first_after_last": F.col("first_date") > F.col("last_date"),
                "no_rows": F.col("row_count") <= 0,
                "leftover_error": F.coalesce("last_error", F.lit("")) != "",
            },
        ),
    )
