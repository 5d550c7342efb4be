"""Manifests as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.errors import ManifestError
from barlake.functions.numbers import variant_text


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row: manifest VARIANT."""
    row = parse_manifest(spark.read.text(path, wholetext=True))
    kind = row.select(F.schema_of_variant("manifest").alias("k")).first()
    if kind is None or not (kind.k or "").startswith("OBJECT"):
        raise ManifestError(f"not a JSON object: {path}")
    return row


def parse_manifest(text: DataFrame, column: str = "value") -> DataFrame:
    return text.select(F.try_parse_json(F.col(column)).alias("manifest"))


def asset_rows(manifest: DataFrame) -> DataFrame:
    """(key, asset_name, local_path, size_bytes, sha256, kind of size_bytes)."""
    entries = F.try_variant_get(F.col("manifest"), "$.assets", "map<string,variant>")
    size = F.try_variant_get(F.col("a"), "$.size_bytes", "variant")
    return manifest.select(F.explode(entries).alias("key", "a")).select(
        "key",
        variant_text(F.col("a"), "$.asset_name").alias("asset_name"),
        variant_text(F.col("a"), "$.local_path").alias("local_path"),
        F.when(F.schema_of_variant(size) == "BIGINT", F.try_variant_get(size, "$", "bigint")).alias("size_bytes"),
        F.lower(variant_text(F.col("a"), "$.sha256")).alias("sha256"),
        F.schema_of_variant(size).alias("kind"),
    )


def partition_counts(manifest: DataFrame) -> DataFrame:
    """(year, n); n is NULL unless it is written as an integer."""
    entries = F.try_variant_get(F.col("manifest"), "$.partition_row_counts", "map<string,variant>")
    n = F.when(F.schema_of_variant("c") == "BIGINT", F.try_variant_get(F.col("c"), "$", "bigint"))
    return manifest.select(F.explode(entries).alias("year", "c")).select("year", n.alias("n"))


def part_rows(manifest: DataFrame) -> DataFrame:
    """(key, n, local_path, size_bytes, sha256) of the parts of years that are stored in several files; n counts from 0."""
    entries = F.try_variant_get(F.col("manifest"), "$.partition_files", "map<string,array<variant>>")
    size = F.try_variant_get(F.col("p"), "$.size_bytes", "variant")
    return (
        manifest.select(F.explode(entries).alias("key", "listed"))
        .select("key", F.posexplode("listed").alias("n", "p"))
        .select(
            "key",
            F.col("n").cast("bigint").alias("n"),
            variant_text(F.col("p"), "$.local_path").alias("local_path"),
            F.when(F.schema_of_variant(size) == "BIGINT", F.try_variant_get(size, "$", "bigint")).alias("size_bytes"),
            F.lower(variant_text(F.col("p"), "$.sha256")).alias("sha256"),
        )
    )
