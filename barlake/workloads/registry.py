"""Query registry: name -> (Spark callable, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barlake.workloads.inputs import sql as with_inputs

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Runner
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a callable; sql may name the derived inputs of workloads.inputs."""

    def register(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Query(run, with_inputs(sql) if sql else None)
        return run

    return register
