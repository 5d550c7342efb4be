"""Cleaning, duplicate folding and key checks of daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions.numbers import in_range, round_volume, valid_bar
from barlake.schema import BAR_COLUMNS, BAR_KEY, BAR_VALUES


def typed(df: DataFrame) -> DataFrame:
    """Project to the stored column types. Overflow fails under ANSI casts."""
    return df.select(
        F.col("date").cast("date").alias("date"),
        F.col("ticker").cast("string").alias("ticker"),
        F.col("close").cast("double").alias("close"),
        F.col("adj_close").cast("double").alias("adj_close"),
        round_volume(F.col("volume").cast("double")).alias("volume")
        if dict(df.dtypes)["volume"] in ("double", "float")
        else F.col("volume").cast("bigint").alias("volume"),
    )


def valid_rows(raw: DataFrame, start, end) -> DataFrame:
    return typed(raw.where(valid_bar(start, end)))


def count_invalid(raw: DataFrame, start, end) -> DataFrame:
    return raw.agg(F.count_if(~valid_bar(start, end)).alias("invalid_rows"))


def _differs() -> Column:
    pairs = [F.col(f"_min_{c}") != F.col(f"_max_{c}") for c in BAR_VALUES]
    return pairs[0] | pairs[1] | pairs[2]


def fold_keys(df: DataFrame) -> DataFrame:
    """One row per (date, ticker): the values, how often they occurred, whether they conflict.

    Only fixed-width min/max/count buffers, so it is one hash aggregate with a map-side combine;
    any number of copies of one key costs one row per map task in the shuffle.
    """
    bounds = [f(c).alias(f"_{n}_{c}") for c in BAR_VALUES for n, f in (("min", F.min), ("max", F.max))]
    folded = df.groupBy(*BAR_KEY).agg(*bounds, F.count(F.lit(1)).alias("copies"))
    return folded.select(
        *BAR_KEY, *[F.col(f"_min_{c}").alias(c) for c in BAR_VALUES], "copies", _differs().alias("conflict")
    )


def fold_raw(raw: DataFrame, start, end) -> DataFrame:
    """Clean and fold in one pass, keeping the invalid rows as counts.

    Groups with copies = 0 hold only invalid rows; their values are NULL.
    """
    ok = valid_bar(start, end)
    volume = round_volume(F.col("volume").cast("double"))
    values = {"close": F.col("close"), "adj_close": F.col("adj_close"), "volume": volume}
    marked = raw.select(
        *BAR_KEY, ok.alias("_ok"), *[F.when(ok, v).alias(c) for c, v in values.items()]
    )
    bounds = [f(c).alias(f"_{n}_{c}") for c in BAR_VALUES for n, f in (("min", F.min), ("max", F.max))]
    folded = marked.groupBy(*BAR_KEY).agg(
        *bounds, F.count_if("_ok").alias("copies"), F.count_if(~F.col("_ok")).alias("invalid")
    )
    return folded.select(
        *BAR_KEY,
        *[F.col(f"_min_{c}").alias(c) for c in BAR_VALUES],
        "copies",
        "invalid",
        F.coalesce(_differs(), F.lit(False)).alias("conflict"),
    )


def folded_bars(folded: DataFrame) -> DataFrame:
    return folded.where("copies > 0 AND NOT conflict").select(*BAR_COLUMNS)


def conflicts(folded: DataFrame) -> DataFrame:
    return folded.where("conflict").select(*BAR_KEY, "copies")


def duplicates_removed(folded: DataFrame) -> DataFrame:
    """Exact copies dropped; conflicting groups are refused, not dropped, so they do not count."""
    return folded.agg(
        F.coalesce(F.sum(F.when(~F.col("conflict") & (F.col("copies") > 0), F.col("copies") - 1)), F.lit(0)).alias(
            "duplicate_rows"
        )
    )


def repeated_keys(df: DataFrame) -> DataFrame:
    return df.groupBy(*BAR_KEY).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def tallies(folded: DataFrame) -> DataFrame:
    """Per (ticker, year) all that a fold is asked for: bars with the bounds of their dates, invalid rows, conflicts, copies removed.

    One pass over the folded rows; outcomes, counts and kept partials follow from its rows.
    """
    kept = (F.col("copies") > 0) & ~F.col("conflict")
    day = F.when(kept, F.col("date"))
    return folded.groupBy("ticker", F.year("date").alias("year")).agg(
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
        F.count_if(kept).alias("row_count"),
        F.sum("invalid").alias("invalid"),
        F.count_if("conflict").alias("conflict_keys"),
        F.coalesce(F.sum(F.when(kept, F.col("copies") - 1)), F.lit(0)).alias("duplicate_rows"),
    )


def ticker_outcomes(folded: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Per ticker: success, failed InvalidData, or (requested but absent) no_data."""
    seen = folded.groupBy("ticker").agg(
        F.count_if((F.col("copies") > 0) & ~F.col("conflict")).alias("row_count"),
        F.sum("invalid").alias("invalid_rows"),
        F.count_if("conflict").alias("conflict_keys"),
    )
    return _outcomes(seen, requested)


def tallied_outcomes(tallied: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """ticker_outcomes from the tallies of the folded rows."""
    seen = tallied.groupBy("ticker").agg(
        F.sum("row_count").alias("row_count"), F.sum("invalid").alias("invalid_rows"), F.sum("conflict_keys").alias("conflict_keys")
    )
    return _outcomes(seen, requested)


def _outcomes(seen: DataFrame, requested: DataFrame | None) -> DataFrame:
    if requested is not None:
        seen = requested.select("ticker").join(seen, "ticker", "left")
    count = F.coalesce("row_count", F.lit(0))
    invalid = F.coalesce("invalid_rows", F.lit(0))
    clash = F.coalesce("conflict_keys", F.lit(0))
    return seen.select(
        "ticker",
        F.when(clash > 0, "failed").when(count > 0, "success").when(invalid > 0, "failed").otherwise("no_data").alias("outcome"),
        F.when(clash > 0, "DataConflictError").when(count > 0, "").when(invalid > 0, "InvalidData").otherwise("NoData").alias("error_type"),
        count.alias("row_count"),
        invalid.alias("invalid_rows"),
    )


def in_date_range(df: DataFrame, start, end) -> DataFrame:
    return df.where(in_range(F.col("date"), start, end))


def canonical_sort(df: DataFrame) -> DataFrame:
    return df.orderBy(*BAR_KEY)


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def rows_per_year(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("row_count"))


def distinct_tickers_and_years(df: DataFrame) -> DataFrame:
    """Exact distinct counts of one scan; both columns' values combine map-side."""
    return df.agg(F.count_distinct("ticker").alias("tickers"), F.count_distinct(F.year("date")).alias("years"))
