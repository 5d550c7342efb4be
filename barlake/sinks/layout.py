"""The plain-file layout of a published dataset: a named file, or numbered parts, per year, and a file per report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.errors import BarlakeError
from barlake.session import scratch
from barlake.sinks.bars import write_years
from barlake.sinks.reports import as_text, json_rows


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _move_single(spark: SparkSession, folder: str, target: str) -> None:
    """Give the one data file of a written folder its published name. Metadata only."""
    fs, path = _filesystem(spark, target)
    names = [s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("part-")]
    if len(names) != 1:
        raise BarlakeError(f"expected one data file in {folder}, found {len(names)}")
    destination = path(target)
    fs.mkdirs(destination.getParent())
    fs.delete(destination, False)
    if not fs.rename(names[0], destination):
        raise BarlakeError(f"cannot publish {target}")


def publish_years(bars: DataFrame, root: str, *, rows_per_file: int | None = None) -> None:
    """daily/year=YYYY/prices.parquet, or part-NNNNN.parquet in key order where a year has several files; sorted, zstd.

    The files are written by any number of tasks below a scratch folder and get their names afterwards. Equal years give equal
    files in every run, so that digests tell what changed.
    """
    spark = bars.sparkSession
    staged = scratch(spark, "years")
    write_years(bars, staged, rows_per_file=rows_per_file, fixed=True)
    fs, path = _filesystem(spark, staged)
    for status in fs.listStatus(path(staged)):
        year = status.getPath().getName()
        if not year.startswith("year="):
            continue
        # tasks are numbered in key order, and so are the files of a task
        files = sorted(f.getPath().getName() for f in fs.listStatus(status.getPath()) if f.getPath().getName().startswith("part-"))
        fs.delete(path(f"{root}/daily/{year}"), True)
        fs.mkdirs(path(f"{root}/daily/{year}"))
        for k, name in enumerate(files):
            target = f"{root}/daily/{year}/" + ("prices.parquet" if len(files) == 1 else f"part-{k:05d}.parquet")
            if not fs.rename(path(f"{staged}/{year}/{name}"), path(target)):
                raise BarlakeError(f"cannot publish {target}")


def publish_csv(table: DataFrame, root: str, name: str, order: list) -> None:
    """One sorted CSV file; reports have one row per ticker of a universe of fixed size."""
    staged = scratch(table.sparkSession, "csv")
    rows = as_text(table.orderBy(*order).coalesce(1))
    rows.write.option("header", "true").option("escape", '"').option("emptyValue", "").csv(staged)
    _move_single(table.sparkSession, staged, f"{root}/{name}")


def publish_json(row: DataFrame, root: str, name: str) -> None:
    staged = scratch(row.sparkSession, "json")
    json_rows(row).coalesce(1).write.text(staged)
    _move_single(row.sparkSession, staged, f"{root}/{name}")


def manifest_with_assets(statistics: DataFrame, assets: DataFrame) -> DataFrame:
    """Statistics row plus the asset map, one entry per year and report; and the parts of the years that have some."""
    entry = F.struct("asset_name", "local_path", "size_bytes", "sha256")
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", entry.alias("value"))))).alias("assets")]
    if assets.where("parts IS NOT NULL").limit(1).count():
        listed = F.when(F.col("parts").isNotNull(), F.struct("key", F.col("parts").alias("value")))
        maps.append(F.map_from_entries(F.array_sort(F.collect_list(listed))).alias("partition_files"))
    return statistics.join(assets.agg(*maps), F.lit(True))
