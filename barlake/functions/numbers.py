"""Numeric coercion, bar validity and market-cap parsing (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlake.functions.text import blank_to_null, strip

# --- fixed values: where a screener record may carry its market cap and name ------------
CAP_PATHS = ["$.marketCap", "$['lastclosemarketcap.lasttwelvemonths']", "$.lastclosemarketcap.lasttwelvemonths"]
NAME_PATHS = ["$.longName", "$.shortName", "$.displayName"]
WHOLE_TOLERANCE = 1e-9
# ----------------------------------------------------------------------------------------

INFINITY = float("inf")
NUMBER = r"(?i)\A\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?)\s*\z"


def to_number(c: Column) -> Column:
    """Text to double; anything unparsable is NaN. Java-only spellings such as '12d' do not pass."""
    return F.coalesce(F.when(c.rlike(NUMBER), c.try_cast("double")), F.lit(float("nan")))


def positive_finite(c: Column) -> Column:
    """NaN sorts above infinity in Spark, so the upper bound rejects NaN and infinity alike."""
    return (c > 0) & (c < F.lit(INFINITY))


def whole_volume(c: Column) -> Column:
    """Non-negative, finite and within the tolerance of a whole number."""
    return (c >= 0) & (c < F.lit(INFINITY)) & (F.abs(c - F.rint(c)) <= WHOLE_TOLERANCE)


def round_volume(c: Column) -> Column:
    return F.rint(c).cast("bigint")


def in_range(day: Column, start, end) -> Column:
    """Half-open: start <= day < end."""
    return (day >= F.lit(start)) & (day < F.lit(end))


def valid_bar(start, end) -> Column:
    """Row validity of a raw bar; NULL counts as invalid."""
    rule = (
        in_range(F.col("date"), start, end)
        & positive_finite(F.col("close"))
        & positive_finite(F.col("adj_close"))
        & whole_volume(F.col("volume").cast("double"))
    )
    return F.coalesce(rule, F.lit(False))


def variant_at(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "variant")


def text_of(v: Column) -> Column:
    """The text a variant holds, NULL when it holds anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def variant_text(record: Column, path: str) -> Column:
    return text_of(variant_at(record, path))


def parse_market_cap(v: Column) -> Column:
    """A positive whole number of any JSON kind that means one; booleans and NULL do not."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    digits = F.regexp_extract(strip(F.try_variant_get(v, "$", "string")), r"\A([0-9]+)(?:\.0+)?\z", 1)
    cap = (
        F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        .when(kind == "STRING", F.nullif(digits, F.lit("")).try_cast("bigint"))
        .when(
            kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"),
            F.when(number == F.rint(number), number.try_cast("bigint")),
        )
    )
    return F.when(cap > 0, cap)


def first_cap(values: list[Column]) -> Column:
    return F.coalesce(*[parse_market_cap(v) for v in values])


def first_name(values: list[Column]) -> Column:
    return F.coalesce(*[blank_to_null(text_of(v)) for v in values], F.lit(""))


def market_cap(record: Column) -> Column:
    return first_cap([variant_at(record, p) for p in CAP_PATHS])


def company_name(record: Column) -> Column:
    return first_name([variant_at(record, p) for p in NAME_PATHS])
