"""Queries over the trade tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query."""
    from shelfsight.queries import cleaning, history, market  # noqa: F401
    from shelfsight.queries.registry import QUERIES

    return dict(QUERIES)


def all_twins() -> dict[str, str]:
    """The SQL twin of every query that has one."""
    all_queries()
    from shelfsight.queries.registry import TWINS

    return dict(TWINS)
