"""Registered queries over the test tables, each with its SQL twin where SQL can say it."""

from barlake.workloads import barops, coverage, jobs, scalars, securities, storage, updates
from barlake.workloads.registry import QUERIES

__all__ = ["QUERIES", "barops", "coverage", "jobs", "scalars", "securities", "storage", "updates"]
