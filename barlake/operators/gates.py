"""Violations tables: every gate is an aggregate that yields (rule, n, sample) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.errors import BarlakeError, DataQualityError

SAMPLE_SIZE = 10


def counted(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One aggregate over df: rows where each condition holds, kept only when there are any.

    A condition that evaluates to NULL counts as a violation: an unknown value is not a pass.
    """
    hits = [F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()]
    pairs = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in rules]
    )
    return (
        df.agg(*hits)
        .select(F.inline(pairs))
        .where("n > 0")
        .select("rule", "n", F.lit("").alias("sample"))
    )


def sampled(df: DataFrame, rule: str, label: Column) -> DataFrame:
    """One violation row for a table of offenders: their exact count and the first label."""
    found = df.select(label.cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("sample")
    )
    return found.where("n > 0").select(F.lit(rule).alias("rule"), "n", "sample")


def listed(df: DataFrame, rule: str, label: Column) -> DataFrame:
    """The same with the first labels in order.

    The count aggregates map-side; the sample is a top-k of fixed size, so neither collects the
    offenders into one place.
    """
    labels = df.select(label.cast("string").alias("label"))
    first = (
        labels.distinct()
        .orderBy("label")
        .limit(SAMPLE_SIZE)
        .agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("sample"))
    )
    total = labels.agg(F.count(F.lit(1)).alias("n"))
    return (
        total.where("n > 0")
        .select(F.lit(rule).alias("rule"), "n")
        .join(first, F.lit(True), "inner")
        .select("rule", "n", "sample")
    )


def gather(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)


def enforce(violations: DataFrame, error: type[BarlakeError] = DataQualityError) -> None:
    """Run the gate; raise with its rows. There is one row per rule, never one per offender."""
    found = sorted(violations.collect(), key=lambda r: r.rule)
    if found:
        text = "; ".join(f"{r.rule}: {r.n}" + (f" ({r['sample']})" if r["sample"] else "") for r in found)
        raise error(text)
