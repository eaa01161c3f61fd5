"""Pairwise correlation of the market's measures."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.operators.common import group
from shelfsight.sources.headers import existing

METRICS = (
    "monthly_units", "monthly_revenue", "price",
    "rating", "rating_count", "days_listed",
)


def _pair_r(x: str, y: str) -> Column:
    """Correlation over the rows that have both values, 0 when undefined."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.coalesce(F.try_divide(F.covar_pop(a, b), spread), F.lit(0.0))


def correlation_long(
    df: DataFrame, metrics: Sequence[str] = METRICS, by: Sequence[str] = ()
) -> DataFrame:
    """One row (x, y, r) per ordered pair of metrics that vary.

    All pairs come from a single aggregation. ``corr`` is not used because it
    raises on a constant input.
    """
    names = existing(df, metrics)
    typed = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names])
    stats = group(typed, by).agg(
        *[(F.min(c) < F.max(c)).alias(f"varies_{c}") for c in names],
        *[_pair_r(x, y).alias(f"r_{x}_{y}") for x, y in combinations(names, 2)],
    )

    def cell(x: str, y: str) -> Column:
        first, second = sorted((x, y), key=names.index)
        r = F.lit(1.0) if x == y else F.col(f"r_{first}_{second}")
        return F.struct(
            F.lit(x).alias("x"),
            F.lit(y).alias("y"),
            r.alias("r"),
            (F.col(f"varies_{x}") & F.col(f"varies_{y}")).alias("vary"),
        )

    varying = sum(
        (F.coalesce(F.col(f"varies_{c}"), F.lit(False)).cast("int") for c in names),
        F.lit(0),
    )
    return (
        stats.where(varying > 1)
        .select(*by, F.explode(F.array(*[cell(x, y) for x in names for y in names])).alias("c"))
        .where("c.vary")
        .select(*by, "c.x", "c.y", "c.r")
    )
