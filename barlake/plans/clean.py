"""clean_bars: a raw feed becomes unique valid bars plus an outcome per ticker."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.errors import ConflictError
from barlake.operators.bars import conflicts, fold_raw, folded_bars, tallied_outcomes, tallies, ticker_outcomes
from barlake.operators.gates import enforce, sampled
from barlake.session import cut
from barlake.sources.prices import column_outcomes, wide_to_long


@dataclass(frozen=True)
class CleanBars:
    """All tables derive from `folded`, one row per (date, ticker); `tallies` has one per (ticker, year)."""

    folded: DataFrame
    bars: DataFrame
    outcomes: DataFrame
    conflicts: DataFrame
    tallies: DataFrame

    def counts(self) -> tuple[int, int]:
        """(invalid rows, duplicate rows removed)."""
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("invalid", "duplicate_rows")]
        row = self.tallies.agg(*sums).first()
        return row.invalid, row.duplicate_rows

    def partials(self) -> DataFrame:
        """operators.partials.partials of the bars."""
        return self.tallies.where("row_count > 0").select("ticker", "year", "first_date", "last_date", "row_count")

    def enforce(self) -> None:
        label = F.concat_ws(" ", F.col("date").cast("string"), "ticker")
        enforce(sampled(self.conflicts, "conflicting_values", label), ConflictError)


def clean_bars(raw: DataFrame, start, end, requested: DataFrame | None = None, *, materialize: bool = False) -> CleanBars:
    """One scan and one shuffle of the raw rows. materialize writes the folded table and its tallies once, for
    callers that use several of the results."""
    folded = fold_raw(raw, start, end)
    if not materialize:
        return CleanBars(folded, folded_bars(folded), ticker_outcomes(folded, requested), conflicts(folded), tallies(folded))
    folded = cut(folded)
    tallied = cut(tallies(folded))
    return CleanBars(folded, folded_bars(folded), tallied_outcomes(tallied, requested), conflicts(folded), tallied)


def clean_wide(wide: DataFrame, requested: list[str], start, end, date: str = "date", *, materialize: bool = False) -> CleanBars:
    """The same for a wide response; tickers decided by its columns keep that outcome."""
    decided = column_outcomes(wide, requested, date)
    names = wide.sparkSession.createDataFrame([(t,) for t in requested], "ticker string")
    open_tickers = names.join(decided, "ticker", "left_anti")
    cleaned = clean_bars(wide_to_long(wide, requested, date), start, end, open_tickers, materialize=materialize)
    zero = F.lit(0).cast("bigint")
    outcomes = cleaned.outcomes.unionByName(
        decided.select("ticker", "outcome", "error_type", zero.alias("row_count"), zero.alias("invalid_rows"))
    )
    return CleanBars(cleaned.folded, cleaned.bars, outcomes, cleaned.conflicts, cleaned.tallies)
