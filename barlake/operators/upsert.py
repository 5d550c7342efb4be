"""Upsert of a refresh window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators.gates import counted, gather
from barlake.operators.layers import last_layer
from barlake.operators.quality import bar_violations
from barlake.schema import BAR_COLUMNS, BAR_KEY, BAR_VALUES


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values win per key, old keys the feed omitted stay; running it twice changes nothing.

    Both sides are unique per key, so last-wins is a max over each side's own columns: one
    shuffle and a fixed-width hash aggregate, no sort and no per-key window. When Spark finds the
    new side small enough to broadcast, upsert_small avoids even that shuffle.
    """
    sides = old.select(*BAR_COLUMNS, F.lit(False).alias("_new")).unionByName(
        new.select(*BAR_COLUMNS, F.lit(True).alias("_new"))
    )
    picked = [F.max(F.when(F.col("_new"), F.col(c))).alias(f"_new_{c}") for c in BAR_VALUES]
    kept = [F.max(F.when(~F.col("_new"), F.col(c))).alias(f"_old_{c}") for c in BAR_VALUES]
    merged = sides.groupBy(*BAR_KEY).agg(*picked, *kept)
    return merged.select(*BAR_KEY, *[F.coalesce(f"_new_{c}", f"_old_{c}").alias(c) for c in BAR_VALUES])


def upsert_small(old: DataFrame, new: DataFrame) -> DataFrame:
    """Same result as an anti join: Spark broadcasts new under its size threshold, else shuffles."""
    untouched = old.select(*BAR_COLUMNS).join(new.select(*BAR_KEY), BAR_KEY, "left_anti")
    return untouched.unionByName(new.select(*BAR_COLUMNS))


def keep_last_by_source(df: DataFrame, source: str) -> DataFrame:
    """Per key the row of the highest source number; at most one row per key and source."""
    return last_layer(df, source)


def upsert_violations(old: DataFrame, new: DataFrame, refresh_start, target, allowed: DataFrame | None) -> DataFrame:
    """New rows must be canonical inside the window; old rows may not lie after the target."""
    return gather(
        bar_violations(new, refresh_start, F.date_add(F.lit(target), 1), allowed),
        counted(old, {"old_rows_after_target": F.col("date") > F.lit(target)}),
    )
