"""reconcile_copies: what a copy of a dataset lacks, holds stale, or holds in excess."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.errors import IdentityError
from barlake.operators.gates import enforce
from barlake.operators.inventory import (
    asset_files,
    asset_key,
    identity_of,
    identity_violations,
    missing_and_obsolete,
    publication_order,
    reconcile,
)
from barlake.sources.files import inventory
from barlake.sources.manifest import asset_rows, part_rows, read_manifest


@dataclass(frozen=True)
class Reconciled:
    plan: DataFrame
    names: DataFrame
    order: DataFrame


def reconcile_copies(
    spark: SparkSession,
    manifest_path: str,
    copy_root: str,
    *,
    expected_identity: DataFrame | None = None,
    force: bool = False,
    years: list[int] | None = None,
    auxiliary: list[str] | None = None,
) -> Reconciled:
    """Compare a manifest with the files below copy_root; a foreign identity is refused first.

    The parts of a year are compared one by one, so only those that differ are fetched.
    """
    manifest = read_manifest(spark, manifest_path)
    if expected_identity is not None:
        enforce(identity_violations(expected_identity, identity_of(manifest)), IdentityError)
    assets = asset_files(asset_rows(manifest), part_rows(manifest))
    local = inventory(spark, copy_root)
    managed_local = local.where(asset_key(F.col("local_path")).isNotNull())
    return Reconciled(
        reconcile(assets, local, force=force, years=years, auxiliary=auxiliary),
        missing_and_obsolete(assets, managed_local, "local_path"),
        publication_order(assets),
    )
