"""Year-partitioned bar files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barlake.errors import RefreshError
from barlake.operators.gates import enforce, gather
from barlake.operators.quality import key_violations, schema_violations, unexpected_tickers, value_rules
from barlake.schema import BAR_COLUMNS, BAR_KEY, VIOLATION_SCHEMA

#: Rows of a task, and so of a file at most, where files are cut by their keys alone; and how many marked keys make one such cut.
ROWS_PER_TASK = 1 << 19
SAMPLED = 100
#: A footer lists a column's encodings in the order of a hash set, which each JVM has its own of. Written so, a column has one encoding.
ONE_ENCODING = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}


def _laid_out(df: DataFrame) -> DataFrame:
    rows = df.select(*BAR_COLUMNS, F.year("date").alias("year"))
    keys = ["year", *BAR_KEY]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _bounds(rows: DataFrame, step: int) -> list:
    """(year, bounds) for each year: keys that cut it into runs of about `step` rows, and depend on nothing but the year's own keys.

    Every `SAMPLED`-th of the keys whose hash marks them is a bound. A year's row holds a key of `step / SAMPLED` of its own.
    """
    every = max(1, step // SAMPLED)
    key = F.struct(*BAR_KEY)
    marked = F.array_sort(F.collect_list(F.when(F.pmod(F.xxhash64(*BAR_KEY), F.lit(every)) == 0, key)))
    kept = F.filter(marked, lambda _, k: (k + 1) % min(SAMPLED, step) == 0)
    return rows.groupBy("year").agg(kept.alias("bounds")).orderBy("year").collect()


def _fixed_out(df: DataFrame, step: int) -> DataFrame:
    """`_laid_out` with partitions that the keys alone decide: equal bars are cut alike in every run, whatever the other years and values.

    A range sort cuts where its random sample and the sizes of the values tell it. The bounds, one per partition, pass through the driver.
    """
    rows = df.select(*BAR_COLUMNS, F.year("date").alias("year"))
    days, cuts = _day_places(_bounds(rows, step))
    table = F.broadcast(df.sparkSession.createDataFrame(days, "_day date, _first int, _tickers array<string>"))
    own = F.when(F.size("_tickers") > 0, F.size(F.filter("_tickers", lambda t: t <= F.col("ticker")))).otherwise(F.lit(0))
    placed = rows.join(table, F.col("date") == F.col("_day"), "left").withColumn("_place", F.coalesce(F.col("_first") + own, F.lit(0)))
    return placed.repartitionById(max(cuts, 1), F.col("_place")).sortWithinPartitions("year", *BAR_KEY).select(*rows.columns)


def _day_places(years: list) -> tuple[list, int]:
    """((day, partition of its first key, tickers of the bounds inside it) for each day of the years, number of partitions).

    A row is compared with the bounds of its own day only, so its work does not grow with the number of bounds of its year.
    """
    days, before = [], 0
    for year, bounds in years:
        if year is not None:
            inside: dict[dt.date, list[str | None]] = {}
            for b in bounds:
                inside.setdefault(b.date, []).append(b.ticker)
            first = before
            for n in range((dt.date(year, 12, 31) - dt.date(year, 1, 1)).days + 1):
                day = dt.date(year, 1, 1) + dt.timedelta(days=n)
                tickers = inside.get(day, [])
                # an unknown ticker sorts before all others of its day
                days.append((day, first + tickers.count(None), [t for t in tickers if t is not None]))
                first += len(tickers)
        before += len(bounds) + 1
    return days, before


def observed(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows, and how many of them break each rule, counted while they pass by.

    An unknown value is a violation, as in operators.gates.counted. Put this right before a write: further up, the sampling of a range sort would
    pass by as well.
    """
    seen = Observation()
    return df.observe(seen, *[F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()]), seen


def observed_violations(spark: SparkSession, seen: Observation) -> DataFrame:
    """What a written table's observation counted, as a gate's rows; waits for the write."""
    rows = [(rule, n, "") for rule, n in sorted(seen.get.items()) if n]
    return spark.createDataFrame(rows, VIOLATION_SCHEMA)


def write_years(
    df: DataFrame,
    path: str,
    *,
    mode: str = "error",
    rules: dict[str, Column] | None = None,
    rows_per_file: int | None = None,
    fixed: bool = False,
) -> Observation | None:
    """zstd Parquet below year=YYYY, every file sorted by (date, ticker).

    The rows are range-partitioned by (year, date, ticker): files hold disjoint key ranges, one
    year can span any number of tasks, and a hot ticker spreads over its dates. The files of a year are in the order of
    their names. With rules, they are counted during the write. With `fixed`, files of equal bars are equal, whichever executors write them.
    """
    rows, seen = _fixed_out(df, ROWS_PER_TASK) if fixed else _laid_out(df), None
    if rules:
        rows, seen = observed(rows, rules)
    (
        rows.write.mode(mode)
        .options(**ONE_ENCODING if fixed else {})
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file or 0)
        .partitionBy("year")
        .parquet(path)
    )
    return seen


def rewrite_years(df: DataFrame, path: str, years: list[int]) -> None:
    """Replace only the given years of a dataset; a year that would end up empty is an error.

    df must not read from path. Partitions are swapped one by one; sinks.snapshots is the form
    that readers see change all at once.
    """
    present = {r.year for r in df.select(F.year("date").alias("year")).distinct().collect()}
    empty = sorted(set(years) - present)
    if empty:
        raise RefreshError(f"updated partitions would be empty: {empty}")
    stray = sorted(present - set(years))
    if stray:
        raise RefreshError(f"rows outside the affected years: {stray}")
    (
        _laid_out(df)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("year")
        .parquet(path)
    )


def write_staged(df: DataFrame, path: str, start, end, allowed: DataFrame | None = None) -> DataFrame:
    """Write a staging table and refuse it if it is none of bars.

    The value rules are counted during the write. Keys and tickers, which take a shuffle, are checked on what was stored: one scan of
    two columns for the keys, and of one for the tickers.
    """
    rows = df.select(*BAR_COLUMNS)
    passing, seen = observed(rows, value_rules(start, end))
    passing.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(rows.schema).parquet(path)
    found = [observed_violations(df.sparkSession, seen), schema_violations(stored), key_violations(stored)]
    if allowed is not None:
        found.append(unexpected_tickers(stored, allowed))
    enforce(gather(*found))
    return stored
