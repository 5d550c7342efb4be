"""Calendar-date expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlake.schema import MARKET_TIMEZONE, REFRESH_DAYS

WALL_CLOCK = (
    r"\A\s*([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{1,9})?)?)?"
    r"\s*(?:Z|UTC|[+-][0-9]{2}(?::?[0-9]{2})?)?\s*\z"
)


def calendar_date(c: Column) -> Column:
    """Civil date of a timestamp text as written: the zone is dropped, not converted."""
    return F.regexp_extract(c, WALL_CLOCK, 1).try_cast("date")


def market_date(utc: Column, timezone: str = MARKET_TIMEZONE) -> Column:
    """Civil date at the market of a UTC wall clock (timestamp_ntz)."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc))


def exclusive_end(utc: Column, timezone: str = MARKET_TIMEZONE) -> Column:
    return F.date_add(market_date(utc, timezone), 1)


def refresh_start(dataset_start: Column, target: Column, days: int = REFRESH_DAYS) -> Column:
    """Rolling window start, clamped to the dataset start; NULL when the start is after the target."""
    if days < 0:
        raise ValueError("refresh days cannot be negative")
    return F.when(dataset_start <= target, F.greatest(dataset_start, F.date_sub(target, days)))


def affected_years(start: Column, target: Column) -> Column:
    """Inclusive array of years; NULL when the window is empty."""
    return F.when(start <= target, F.sequence(F.year(start), F.year(target)))


def partition_year(day: Column) -> Column:
    return F.year(day)


def iso(day: Column) -> Column:
    """YYYY-MM-DD, empty for NULL."""
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))
