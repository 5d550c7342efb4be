"""Universe, audit and manual-exclusion files, and screener pages."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.errors import SourceError, UniverseError
from barlake.functions.text import blank_to_null, normalize_ticker, strip
from barlake.operators.gates import enforce, gather, listed, sampled
from barlake.operators.ordering import first_occurrence, with_position
from barlake.schema import AUDIT_SCHEMA, UNIVERSE_SCHEMA


def read_exact_csv(spark: SparkSession, path: str, schema: T.StructType, error: type[Exception] = SourceError) -> DataFrame:
    """A CSV whose header must be exactly the schema's names; unparsable values fail the job."""
    header = spark.read.csv(path, header=True).columns
    if header != schema.fieldNames():
        raise error(f"unexpected columns in {path}: {header}")
    # every file's own header is held against the schema when it is read
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST", escape='"', multiLine=False)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    return read_exact_csv(spark, path, UNIVERSE_SCHEMA, UniverseError)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return read_exact_csv(spark, path, AUDIT_SCHEMA, UniverseError)


def ticker_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, raw, ticker) of a CSV that has a ticker column; blank tickers are skipped.

    The order is that of the ranks if every row has one, else that of the files: by file name, then
    by place in the file.
    """
    raw = spark.read.csv(path, header=True, escape='"')
    names = [c.lstrip("﻿") for c in raw.columns]
    if "ticker" not in names:
        raise SourceError(f"missing required 'ticker' column: {path}")
    rows = raw.toDF(*names)
    rank = F.col("market_cap_rank").try_cast("bigint") if "market_cap_rank" in names else F.lit(None).cast("bigint")
    # rows of a split are numbered in order, and splits of a file by where they start
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    kept = rows.select(rank.alias("rank"), F.col("ticker").alias("raw"), *[c.alias(f"_place{i}") for i, c in enumerate(place)]).where(
        blank_to_null(F.col("raw")).isNotNull()
    )
    placed = with_position(kept, [F.col(f"_place{i}") for i in range(len(place))])
    ranked = not placed.where("rank IS NULL").limit(1).count()
    return placed.select(F.col("rank" if ranked else "position").alias("ord"), "raw", normalize_ticker(F.col("raw")).alias("ticker"))


def load_universe(spark: SparkSession, path: str) -> DataFrame:
    """(ord, ticker): unique normalised tickers; an invalid one or an empty file fails."""
    lines = ticker_lines(spark, path)
    none = lines.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    enforce(
        gather(
            sampled(lines.where("ticker IS NULL"), "invalid_ticker", F.col("raw")),
            sampled(none, "no_tickers", F.col("n")),
        ),
        SourceError,
    )
    return first_occurrence(lines, "ticker", "ord").select("ord", "ticker")


def exclusion_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, ticker) of a comment-friendly list; a missing file is an empty list."""
    try:
        text = spark.read.text(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "value string")
    line = strip(F.col("value"))
    return (
        text.select(line.alias("line"))
        .where((F.col("line") != "") & ~F.col("line").startswith("#"))
        .withColumn("ticker", normalize_ticker(F.col("line")))
    )


def manual_exclusions(spark: SparkSession, path: str) -> DataFrame:
    lines = exclusion_lines(spark, path)
    enforce(sampled(lines.where("ticker IS NULL"), "invalid_exclusion", F.col("line")), SourceError)
    return lines.select("ticker").distinct()


def parse_pages(pages: DataFrame, page: str = "page", text: str = "value") -> DataFrame:
    """One row per quote of each JSON page: (page, pos, raw_count, record VARIANT, problem).

    A page holds at most one feed page of quotes. A page that is no object with a quotes list
    yields one row with a problem.
    """
    body = F.try_parse_json(F.col(text))
    quotes = F.try_variant_get(body, "$.quotes", "array<variant>")
    kind = F.schema_of_variant(F.try_variant_get(body, "$.quotes", "variant"))
    parsed = pages.select(
        F.col(page).alias("page"),
        quotes.alias("_quotes"),
        F.when(F.coalesce(kind.startswith("ARRAY"), F.lit(False)), F.lit(None).cast("string")).otherwise("no_quotes_list").alias("problem"),
    )
    return parsed.select(
        "page", "problem", F.size("_quotes").cast("bigint").alias("raw_count"), F.posexplode_outer("_quotes").alias("pos", "record")
    ).where("problem IS NOT NULL OR record IS NOT NULL")


def page_files(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(page, path) of the page files below a folder in the order of their pages; only names are looked at."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, listing = [], system.listFiles(path, True)
    while listing.hasNext():
        file = listing.next().getPath()
        if not re.match(r"[._]", file.getName()):
            text = file.toString()
            number = re.search(r"page=(\d+)/", text) or re.search(r"(\d+)[^\d/]*$", text)
            if number is None:
                raise SourceError(f"no page number in {text}")
            found.append((int(number[1]), text))
    return sorted(found)


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every file is one page; its number is that of its `page=` folder, else the last one in its name."""
    source = F.col("_metadata.file_path")
    number = F.coalesce(F.nullif(F.regexp_extract(source, r"page=(\d+)/", 1), F.lit("")), F.regexp_extract(source, r"(\d+)[^\d/]*$", 1))
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return parse_pages(files.select(number.try_cast("bigint").alias("page"), "value"))


def page_violations(parsed: DataFrame) -> DataFrame:
    return listed(parsed.where("problem IS NOT NULL"), "invalid_page", F.col("page"))
