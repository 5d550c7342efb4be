"""Exact global positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.session import cut

ROWS_PER_PARTITION_BITS = 33  # layout of monotonically_increasing_id


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add 1-based positions in the given total order.

    The rows are range-sorted and written once with their (partition, offset) stamp. Positions
    are then the stamp's offset plus the rows of earlier partitions. Only the partition counts,
    one row per partition, meet in one task.
    """
    stamped = cut(df.orderBy(*order).withColumn("_stamp", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_stamp"), ROWS_PER_PARTITION_BITS)
    counts = stamped.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    offset_in_part = F.col("_stamp").bitwiseAND(F.lit((1 << ROWS_PER_PARTITION_BITS) - 1))
    # the offsets table has one row per partition of the sort, so a broadcast is always small
    return (
        stamped.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + offset_in_part + 1)
        .drop("_part", "_before", "_stamp")
    )


def first_occurrence(df: DataFrame, key: str, order: str) -> DataFrame:
    """Earliest order per key. An aggregate, so copies of a hot key collapse before the shuffle."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def in_batches(df: DataFrame, order: list[Column], size: int, limit: int) -> DataFrame:
    """Number consecutive batches of the given size from 0."""
    if not 1 <= size <= limit:
        raise ValueError(f"batch size must be between 1 and {limit}")
    placed = with_position(df, order)
    return placed.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("bigint"))
