"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with all its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def rows(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    """A batch from lists or arrays by column name, in the order of the schema."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(sizes: Iterable[int], budget: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours whose sizes add up to about the budget; a larger one is a run of its own."""
    start = total = at = 0
    for at, n in enumerate(sizes):
        if total and total + n > budget:
            yield start, at
            start, total = at, 0
        total += n
    if total or start <= at:
        yield start, at + 1


def fixed_hash(words: list[bytes] | list[str], seed: int = 0) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def mix64(x: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash from one: the finisher of a multiply-xorshift generator."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bounded_sample(df: DataFrame, key: Column, size: int) -> DataFrame:
    """At most `size` distinct rows, those with the smallest key hash: the same rows whatever the partitioning."""
    return df.distinct().orderBy(F.xxhash64(key), key).limit(size)


def sampled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, the other columns of chosen and text of each chosen doc_id: one row each, its smallest text."""
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy(*chosen.columns).agg(F.min("text").alias("text"))


def free_names(taken: Iterable[str], wanted: Iterable[str]) -> list[str]:
    """The wanted names, each with as many underscores behind it as make it differ from all taken ones."""
    used = {n.lower() for n in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out
