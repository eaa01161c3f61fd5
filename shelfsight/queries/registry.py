"""Named queries over the trade tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, twin: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if twin is not None:
            TWINS[name] = twin
        return fn

    return register


def sql_round(x: str, digits: int) -> str:
    """Half-even rounding of a number's decimal reading, as SQL."""
    scale = 10 ** (6 - digits)
    units = f"CAST(CAST({x} AS DECIMAL(30, 6)) * 1000000 AS BIGINT)"
    half = scale // 2
    return (
        f"CAST(({units} // {scale}) + CASE WHEN {units} % {scale} > {half} OR "
        f"({units} % {scale} = {half} AND ({units} // {scale}) % 2 = 1) "
        f"THEN 1 ELSE 0 END AS DOUBLE) / {10**digits}"
    )
