"""Revenue by brand and how concentrated it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.functions.numbers import share_of
from shelfsight.operators.common import attach, group, money_sum, top_n, total_money


def brand_revenue(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue of each brand and its share of the market, all brands."""
    brands = df.groupBy(*by, "brand").agg(
        money_sum(F.col("monthly_revenue")).alias("revenue")
    )
    total = group(brands, by).agg(total_money(F.col("revenue")).alias("market_revenue"))
    return attach(brands, total, by).withColumn(
        "share_pct", share_of(F.col("revenue"), F.col("market_revenue"))
    )


def top_brands(df: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` brands with most revenue; the name decides ties."""
    return top_n(
        brand_revenue(df, by), [F.desc("revenue"), F.asc("brand")], n, by
    )


def concentration(
    df: DataFrame, sizes: Sequence[int] = (5, 10), by: Sequence[str] = ()
) -> DataFrame:
    """Share of revenue held by the top brands: one ``cr<n>`` per size."""
    leaders = top_brands(df, max(sizes), by)
    # A market has at most max(sizes) rows here.
    place = F.row_number().over(
        Window.partitionBy(*[F.col(c) for c in by]).orderBy(
            F.desc("revenue"), F.asc("brand")
        )
    )
    total = F.coalesce(F.max("market_revenue"), F.lit(0.0))
    placed = leaders.withColumn("place", place)
    return group(placed, by).agg(
        total.alias("total_revenue"),
        *[
            share_of(
                total_money(F.when(F.col("place") <= n, F.col("revenue"))), total
            ).alias(f"cr{n}")
            for n in sizes
        ],
    )
