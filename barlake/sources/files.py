"""Facts about stored files: size and digest, codec, sorted blocks of keys, zone maps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.sources.filestream import NAMED_CODEC, FileDigests, ParquetCodecs, reachable

ROWS_PER_BLOCK = 4096
#: Rows of a task of `key_runs`, about.
ROWS_PER_TASK = 1 << 20


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, local_path, size_bytes, sha256) of every file below root.

    Files are streamed by tasks in ranges of fixed size, so a file of any length is hashed in bounded memory. A
    file system that only Spark's own readers can open is read by `inventory_rows`.
    """
    uri = qualified(spark, root)
    if not reachable(uri):
        return inventory_rows(spark, root)
    spark.dataSource.register(FileDigests)
    return spark.read.format(FileDigests.name()).load(uri)


def qualified(spark: SparkSession, root: str) -> str:
    """The folder with the scheme of the default file system, which Spark's writers use for a bare path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def inventory_rows(spark: SparkSession, root: str) -> DataFrame:
    """The same with a binary row per file, hashed in the JVM.

    Spark refuses a file longer than `spark.sql.sources.binaryFile.maxLength` instead of leaving it out.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "[!._]*")
        .load(root)
    )
    base = root.rstrip("/").removeprefix("file:")
    relative = F.regexp_replace("path", F.lit(rf"\A.*?\Q{base}\E/"), F.lit(""))
    return files.select("path", relative.alias("local_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def stored_codecs(spark: SparkSession, root: str) -> DataFrame:
    """(file, codec, row_count) of every Parquet file below root.

    The codec is what Spark's writer put into the file's name. A file under a published name has none there; its codec
    is read from its footer, if tasks can open the file system. Rows are counted from the footers, no column is read.
    """
    file = F.col("_metadata.file_path")
    stored = spark.read.parquet(root)
    counts = stored.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("row_count"))
    named = F.nullif(F.upper(F.regexp_extract("file", NAMED_CODEC, 1)), F.lit(""))
    uri = qualified(spark, root)
    # the names alone tell whether a footer has to be read
    told = all(re.search(NAMED_CODEC, f) for f in stored.inputFiles())
    if told or not reachable(uri):
        return counts.select("file", named.alias("codec"), "row_count")
    spark.dataSource.register(ParquetCodecs)
    footers = spark.read.format(ParquetCodecs.name()).load(uri).select(_plain_uri("path").alias("path"), F.col("codec").alias("of_footer"))
    found = counts.join(footers, _plain_uri("file") == F.col("path"), "left")
    return found.select("file", F.coalesce(named, "of_footer").alias("codec"), "row_count")


def _plain_uri(column: str) -> Column:
    """A URI as Spark reports it and as file systems spell it: encoded characters, and one to three slashes of file:."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def key_runs(spark: SparkSession, *roots: str) -> DataFrame:
    """Summaries of blocks of consecutive rows of each file, for order, uniqueness and zone maps.

    Blocks are numbered by the rows' place in their file and dealt over tasks of about `ROWS_PER_TASK` rows, whatever the
    size of the files; a task sorts its rows and sees each row after the one before it, and so holds no block's list of
    keys. How blocks meet is told by their first and last keys.
    """
    stored = spark.read.parquet(*roots)
    tasks = max(1, -(-stored.count() // ROWS_PER_TASK))  # the footers tell how many rows there are
    rows = stored.select(
        F.col("_metadata.file_path").alias("file"),
        F.expr(f"_metadata.row_index div {ROWS_PER_BLOCK}").alias("block"),
        F.col("_metadata.row_index").alias("row"),
        F.unix_date("date").alias("day"),
        "ticker",
    ).repartition(tasks, "file", "block")
    key = F.struct("day", "ticker")
    in_block = Window.partitionBy("file", "block").orderBy("row")
    keyed = rows.select("file", "block", "row", key.alias("key"), F.lag(key).over(in_block).alias("before"))
    placed = F.struct("row", "key")
    return keyed.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(placed)["key"].alias("first_key"),
        F.max(placed)["key"].alias("last_key"),
        F.min("key").alias("low_key"),
        F.max("key").alias("high_key"),
        F.min("key.ticker").alias("low_ticker"),
        F.max("key.ticker").alias("high_ticker"),
        F.count_if(F.col("key") < F.col("before")).alias("descents"),
        F.count_if(F.col("key") == F.col("before")).alias("repeats"),
        F.count_if(F.col("key.day").isNull() | F.col("key.ticker").isNull()).alias("null_keys"),
    )


def zone_maps(runs: DataFrame) -> DataFrame:
    """Per file the rows, the NULL keys, and the bounds of both key columns, from the summaries of its blocks."""
    return runs.groupBy("file").agg(
        F.sum("rows").alias("row_count"),
        F.sum("null_keys").alias("null_count"),
        F.date_from_unix_date(F.min("low_key.day")).alias("min_date"),
        F.date_from_unix_date(F.max("high_key.day")).alias("max_date"),
        F.min("low_ticker").alias("min_ticker"),
        F.max("high_ticker").alias("max_ticker"),
    )
