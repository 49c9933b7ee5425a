"""Query registry: a name, the Spark job and, where one exists, equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, ctes: str | None = None, select: str | None = None, recursive: bool = False):
    """Register a job; ``ctes`` and ``select`` make up its SQL."""
    def wrap(fn: Job) -> Job:
        QUERIES[name] = fn
        if select is not None:
            head = f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip().strip(',')}\n" if ctes else ""
            SQL[name] = head + select.strip()
        return fn
    return wrap


def load() -> None:
    from trajspark.plans import (  # noqa: F401
        q_align, q_aggregates, q_joins, q_sampling, q_scalars, q_sources, q_splines, q_streaming, q_windows)
