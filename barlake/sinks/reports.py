"""CSV and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.dates import iso


def as_text(df: DataFrame) -> DataFrame:
    """Dates in ISO form, NULL as blank."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            iso(F.col(c)).alias(c) if kinds[c] == "date" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
            for c in df.columns
        ]
    )


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """One header per file. Sorted reports are range-sorted, so file order is row order; a report
    bounded by the universe size comes out as one file under adaptive coalescing."""
    rows = df.orderBy(*order) if order else df
    as_text(rows).write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row with sorted keys."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """A one-row report as one JSON text."""
    json_rows(df).coalesce(1).write.mode("overwrite").text(path)
