"""Price feeds: wide responses, staged batches and the published year partitions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.errors import SourceError
from barlake.functions.dates import calendar_date
from barlake.functions.numbers import to_number
from barlake.functions.text import TICKER_TEXT
from barlake.operators.quality import value_rules
from barlake.schema import BAR_COLUMNS, BAR_SCHEMA, STORED_BAR_SCHEMA

# --- fixed values: required fields of a wide response -----------------------------------
FIELDS = {"close": "close", "adj close": "adj_close", "volume": "volume"}
# ----------------------------------------------------------------------------------------

SEPARATOR = "|"


def _field(label: str) -> str:
    return " ".join(label.replace("_", " ").casefold().split())


def _ticker(label: str) -> str | None:
    text = label.strip().upper()
    return text.replace(".", "-") if re.fullmatch(TICKER_TEXT, text) else None


def resolve_columns(columns: list[str], requested: list[str]) -> dict[str, dict[str, str]]:
    """ticker -> field -> column, from labels "a|b" in either order; schema only, no data read."""
    found: dict[str, dict[str, str]] = {}
    flat = [c for c in columns if SEPARATOR not in c]
    if len(flat) == len(columns) and columns:
        if len(requested) != 1:
            raise SourceError("flat columns cannot be told apart for several tickers")
        labels = [(c, requested[0], _field(c)) for c in flat]
    else:
        labels = []
        wanted = set(requested)
        for c in columns:
            parts = c.split(SEPARATOR)
            fields = [_field(p) for p in parts if _field(p) in FIELDS]
            tickers = [_ticker(p) for p in parts if _ticker(p) in wanted]
            if len(fields) == 1 and len(tickers) == 1:
                labels.append((c, tickers[0], fields[0]))
    for column, ticker, field in labels:
        if field not in FIELDS:
            continue
        fields = found.setdefault(ticker, {})
        if field in fields:
            raise SourceError(f"duplicate {field!r} columns for ticker {ticker}")
        fields[field] = column
    return found


def wide_to_long(wide: DataFrame, requested: list[str], date: str = "date") -> DataFrame:
    """Raw long bars (date, ticker, close, adj_close, volume as DOUBLE) of a wide response.

    Each row unrolls in place into one row per complete ticker, so there is no pivot and no
    shuffle. Tickers without columns or with missing fields contribute no rows here.
    """
    types = dict(wide.dtypes)
    found = resolve_columns([c for c in wide.columns if c != date], requested)
    complete = {t: f for t, f in found.items() if len(f) == len(FIELDS)}
    day = calendar_date(F.col(date)) if types[date] == "string" else F.to_date(date)

    def number(column: str):
        quoted = F.col(f"`{column}`")
        return to_number(quoted) if types[column] == "string" else quoted.cast("double")

    entries = [
        F.struct(F.lit(t).alias("ticker"), *[number(f[k]).alias(v) for k, v in FIELDS.items()])
        for t, f in complete.items()
    ]
    if not entries:
        return wide.sparkSession.createDataFrame([], "date date, ticker string, close double, adj_close double, volume double")
    return wide.select(day.alias("date"), F.inline(F.array(*entries)))


def column_outcomes(wide: DataFrame, requested: list[str], date: str = "date") -> DataFrame:
    """Outcomes the schema alone decides: no columns is no_data, a missing field is failed."""
    found = resolve_columns([c for c in wide.columns if c != date], requested)
    rows = []
    for t in requested:
        missing = sorted(set(FIELDS) - set(found.get(t, {})))
        if t not in found:
            rows.append((t, "no_data", "NoData", ""))
        elif missing:
            rows.append((t, "failed", "MissingFields", f"missing fields: {', '.join(missing)}"))
    return wide.sparkSession.createDataFrame(rows, "ticker string, outcome string, error_type string, message string")


def read_staged(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All staged batch files as one table."""
    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.schema(BAR_SCHEMA).parquet(*paths)


def staged_violations(spark: SparkSession, paths: str | list[str], start, end, allowed: DataFrame | None = None) -> DataFrame:
    """(batch, rule, n) of staged batches, each of which has to be a table of bars by itself.

    Spark merges the footers of all files in a job of its own: a column of another type fails it, a further column
    is a violation of all batches at once (an empty batch name), and what a batch lacks reads as NULL. The value rules of all batches are one
    aggregate over one scan, keys are counted per batch.
    """
    paths = [paths] if isinstance(paths, str) else paths
    own = [(n, t) for n, t in spark.read.option("mergeSchema", "true").parquet(*paths).dtypes]
    wrong = spark.range(0 if own == [(f.name, f.dataType.simpleString()) for f in BAR_SCHEMA] else 1)
    schema = wrong.select(F.lit("").alias("batch"), F.lit("schema").alias("rule"), F.lit(1).cast("bigint").alias("n"))
    # a pattern that is bound to the end only is tried from every character of the path, for every row
    folder = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)
    rows = read_staged(spark, paths).withColumn("batch", folder)
    rules = value_rules(start, end)
    if allowed is not None:
        rows = rows.join(allowed.select("ticker", F.lit(True).alias("_known")), "ticker", "left")
        rules["unexpected_ticker"] = F.col("ticker").isNotNull() & F.col("_known").isNull()
    counts = rows.groupBy("batch").agg(*[F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])
    values = counts.select("batch", F.inline(pairs)).where("n > 0")
    repeats = rows.groupBy("batch", "date", "ticker").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    keys = repeats.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).select("batch", F.lit("duplicate_key").alias("rule"), "n")
    return schema.unionByName(values).unionByName(keys)


def read_dataset(spark: SparkSession, root: str) -> DataFrame:
    """All year=* partitions with the fixed schema plus the directory's year."""
    return spark.read.schema(STORED_BAR_SCHEMA).option("basePath", root).parquet(root)


def read_years(spark: SparkSession, root: str, years: list[int]) -> DataFrame:
    """Only the requested years. The filter names the partition column, so other years are not listed
    among the files to read; filtering on year(date) would scan everything."""
    return read_dataset(spark, root).where(F.col("year").isin([int(y) for y in years]))


def read_window(spark: SparkSession, root: str, start, end) -> DataFrame:
    """Half-open date window; adds the year predicate that makes it prune."""
    day = F.col("date")
    last = F.date_sub(F.lit(end), 1)
    return read_dataset(spark, root).where(
        F.col("year").between(F.year(F.lit(start)), F.year(last)) & (day >= F.lit(start)) & (day < F.lit(end))
    )


def read_keys(spark: SparkSession, root: str, year: int) -> DataFrame:
    return read_years(spark, root, [year]).select("date", "ticker")


def stored_schema_matches(spark: SparkSession, root: str) -> bool:
    """Names and types of the files themselves, read from a footer."""
    actual = [(n, t) for n, t in spark.read.parquet(root).dtypes if n in BAR_COLUMNS or n != "year"]
    return actual == [(f.name, f.dataType.simpleString()) for f in BAR_SCHEMA]
