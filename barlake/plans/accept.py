"""accept_dataset: strict acceptance of a published dataset in its plain-file layout."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.errors import DataQualityError, ManifestError
from barlake.functions.fingerprint import universe_identity
from barlake.operators.coverage import status_counts, universe_coverage
from barlake.operators.gates import counted, enforce, gather, sampled
from barlake.operators.inventory import asset_files, manifest_violations, part_violations, reconcile
from barlake.operators.quality import coverage_row_violations, dataset_violations
from barlake.operators.reports import acceptance_summary
from barlake.schema import STATUSES
from barlake.session import cut
from barlake.sources.files import inventory, key_runs, stored_codecs
from barlake.sources.manifest import asset_rows, part_rows, partition_counts, read_manifest
from barlake.sources.prices import read_dataset
from barlake.sources.reports import read_coverage, read_failures


def manifest_facts(manifest: DataFrame) -> DataFrame:
    """Typed one-row view of the manifest fields that acceptance compares."""
    kinds = {
        "requested_start": "string",
        "requested_end_exclusive": "string",
        "actual_min_date": "string",
        "actual_max_date": "string",
        "universe_sha256": "string",
        "universe_ticker_count": "bigint",
        "successful_ticker_count": "bigint",
        "no_data_ticker_count": "bigint",
        "failed_ticker_count": "bigint",
        "total_row_count": "bigint",
        "partition_row_counts": "map<string,bigint>",
    }
    return manifest.select(
        *[F.try_variant_get(F.col("manifest"), f"$.{n}", t).alias(n) for n, t in kinds.items()]
    )


def acceptance_violations(
    spark: SparkSession, root: str, universe: DataFrame, target: dt.date | None = None, minimum: float = 0.0
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(violations, manifest facts, target coverage or None) of the dataset below root."""
    if not 0 <= minimum <= 1:
        raise ValueError("minimum coverage must be between zero and one")
    if minimum and target is None:
        raise ValueError("a minimum coverage needs a target session")
    manifest = read_manifest(spark, f"{root}/manifest.json")
    assets, counts = asset_rows(manifest), partition_counts(manifest)
    parts = part_rows(manifest)
    enforce(gather(manifest_violations(manifest, assets, counts), part_violations(assets, parts)), ManifestError)

    facts = manifest_facts(manifest)
    row = facts.first()
    start = dt.date.fromisoformat(row.requested_start)
    end = dt.date.fromisoformat(row.requested_end_exclusive)
    daily = f"{root}/daily"
    stored = read_dataset(spark, daily)
    coverage = read_coverage(spark, f"{root}/ticker_coverage.csv")
    failures = read_failures(spark, f"{root}/download_failures.csv")
    expected = counts.select(F.col("year").cast("int").alias("year"), F.col("n").alias("row_count"))
    identity = universe_identity(universe)
    changed = reconcile(asset_files(assets, parts), inventory(spark, root)).where("action = 'download'")
    statuses = status_counts(coverage).join(facts, F.lit(True))
    named = {"success": "successful", "no_data": "no_data", "failed": "failed"}
    found = [
        counted(
            facts.join(identity, F.lit(True)),
            {
                "universe_digest": F.col("universe_sha256") != F.col("sha"),
                "universe_count": F.col("universe_ticker_count") != F.col("n"),
                "actual_dates": (F.col("actual_min_date") < F.col("requested_start"))
                | (F.col("actual_max_date") >= F.col("requested_end_exclusive")),
            },
        ),
        dataset_violations(
            stored, cut(key_runs(spark, daily)), cut(stored_codecs(spark, daily)), start, end, universe, expected
        ),
        sampled(changed, "file_changed", F.col("local_path")),
        coverage_row_violations(coverage, universe),
        sampled(failures, "download_failures", F.col("ticker")),
        counted(statuses, {f"{s}_count": F.col(s) != F.col(f"{named[s]}_ticker_count") for s in STATUSES}),
    ]
    share = None
    if target is not None:
        share = universe_coverage(stored.where(F.col("year") == target.year), universe, target)
        found.append(counted(share, {"target_coverage": F.col("coverage_ratio") < minimum}))
    return gather(*found), facts, share


def accept_dataset(
    spark: SparkSession, root: str, universe: DataFrame, target: dt.date | None = None, minimum: float = 0.0
) -> DataFrame:
    """Raise on any violation, else return the summary row."""
    violations, facts, share = acceptance_violations(spark, root, universe, target, minimum)
    enforce(violations, DataQualityError)
    return acceptance_summary(facts, share, target)


def initial_year_violations(counts: DataFrame, first_year: int) -> DataFrame:
    """The first published dataset must begin in its configured year and not before."""
    bounds = counts.agg(F.min(F.col("year").cast("int")).alias("first"))
    return counted(bounds, {"first_year": F.col("first") != first_year})
