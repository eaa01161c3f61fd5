"""Market headline numbers, shares and data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.config import LOW_RATING, NEW_LABEL_SHORT
from shelfsight.functions.numbers import first_number, share_of
from shelfsight.operators.common import (
    attach,
    group,
    histogram,
    money_avg,
    money_sum,
    top_n,
    total_money,
)


def kpi_parts(df: DataFrame) -> dict[str, Column]:
    """Aggregates of the market headline by name."""
    growth = (
        F.avg(F.col("growth_rate") * 100) if "growth_rate" in df.columns else F.lit(0.0)
    )
    return {
        "products": F.count(F.lit(1)),
        "avg_units": F.avg("monthly_units"),
        "total_units": F.coalesce(F.sum("monthly_units"), F.lit(0)),
        "avg_revenue": money_avg(F.col("monthly_revenue")),
        "total_revenue": money_sum(F.col("monthly_revenue")),
        "avg_price": money_avg(F.col("price")),
        "avg_growth_pct": growth,
        "max_units": F.max("monthly_units"),
    }


def kpi_columns(df: DataFrame) -> list[Column]:
    """Aggregates of the market headline."""
    return [c.alias(name) for name, c in kpi_parts(df).items()]


def market_kpis(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means, totals and the largest unit count of each market, in one pass."""
    return group(df, by).agg(*kpi_columns(df))


def top_category(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent category; the smallest name wins a tie."""
    counted = (
        df.where(F.col("category").isNotNull())
        .groupBy(*by, "category")
        .agg(F.count(F.lit(1)).alias("products"))
    )
    return top_n(counted, [F.desc("products"), F.asc("category")], 1, by)


def count_share(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per value and their share of all rows."""
    counted = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("products"))
    total = group(counted, by).agg(F.sum("products").alias("_total"))
    return (
        attach(counted, total, by)
        .withColumn("share_pct", share_of(F.col("products"), F.col("_total")))
        .drop("_total")
    )


def newness_revenue(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue, count and mean revenue of new and of old listings."""
    split = df.groupBy(*by, "newness").agg(
        F.count(F.lit(1)).alias("products"),
        money_sum(F.col("monthly_revenue")).alias("revenue"),
        money_avg(F.col("monthly_revenue")).alias("avg_revenue"),
    )
    total = group(split, by).agg(total_money(F.col("revenue")).alias("_total"))
    return (
        attach(split, total, by)
        .withColumn("share_pct", share_of(F.col("revenue"), F.col("_total")))
        .drop("_total")
    )


def newcomer_columns(df: DataFrame) -> list[Column]:
    """Aggregates over the listings flagged as new."""
    is_new = F.col("newness").contains(NEW_LABEL_SHORT)
    revenue = F.col("monthly_revenue")
    new_revenue = F.when(is_new, revenue)
    one_if_new = F.when(is_new, 1)
    return [
        F.count(one_if_new).alias("new_products"),
        money_avg(new_revenue).alias("new_avg_revenue"),
        share_of(money_sum(new_revenue), money_sum(revenue)).alias("new_share_pct"),
    ]


def new_product_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean revenue and revenue share of new listings, one row."""
    return group(df, by).agg(*newcomer_columns(df))


def hot_listing_months(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Listing months of products that sell more than the market's mean.

    Works on counts per month and unit number, so no listing is shuffled.
    """
    counts = histogram(df, F.col("monthly_units"), [*by, "listed_month"])
    mean = F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n"))
    return (
        attach(counts, group(counts, by).agg(mean.alias("_mean")), by)
        .where(F.col("value") > F.col("_mean"))
        .where(F.col("listed_month").isNotNull())
        .groupBy(*by, "listed_month")
        .agg(F.sum("n").alias("products"))
    )


def rating_columns(df: DataFrame) -> list[Column]:
    """Aggregates over ratings and reviews; 0 for a column that is absent."""
    rating, reviews, low = F.lit(0.0), F.lit(0.0), F.lit(0)
    if "rating" in df.columns:
        rating = F.avg("rating")
        low = F.count(F.when(F.col("rating") < LOW_RATING, 1))
    if "rating_count" in df.columns:
        reviews = F.avg("rating_count")
    return [
        rating.alias("avg_rating"),
        reviews.alias("avg_reviews"),
        share_of(low, F.count(F.lit(1))).alias("low_rating_pct"),
    ]


def rating_quality(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean rating, mean review count and share of poorly rated products.

    Products without a rating stay in the denominator of the share.
    """
    return group(df, by).agg(*rating_columns(df))


def coverage(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows in which the column has a value."""
    filled = F.count(F.col(f"`{column}`"))
    return group(df, by).agg(
        filled.alias("filled"),
        F.count(F.lit(1)).alias("products"),
        share_of(filled, F.count(F.lit(1))).alias("coverage_pct"),
    )


def data_quality(
    df: DataFrame,
    growth_raw: str,
    price_raw: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Row count, repeated ids, missing growth values and readable prices.

    Growth and price are looked at as they were in the file; after cleaning
    they are never missing. Rows without an id count as one id.
    """
    per_id = df.groupBy(*by, "asin").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(growth_raw).isNull()).alias("no_growth"),
        F.count(first_number(F.col(price_raw))).alias("priced"),
    )
    totals = {
        "rows": F.sum("rows"),
        "duplicate_ids": F.sum(F.col("rows") - 1),
        "missing_growth": F.sum("no_growth"),
        "valid_prices": F.sum("priced"),
    }
    return group(per_id, by).agg(
        *[F.coalesce(total, F.lit(0)).alias(name) for name, total in totals.items()]
    )


def unreadable_sample(
    df: DataFrame, raw: str, clean: str, n: int = 10
) -> DataFrame:
    """The first ``n`` raw texts, by id, that could not be read as numbers."""
    bad = df.where(F.col(clean).isNull() & F.col(raw).isNotNull())
    found = bad.select("asin", F.col(raw).cast("string").alias("raw_value"))
    return found.orderBy("asin", "raw_value").limit(n)


def distinct_brands(df: DataFrame) -> DataFrame:
    """Every brand once, sorted."""
    return df.select("brand").distinct().orderBy("brand")


def brand_filter(
    df: DataFrame, brands: Sequence[str] | DataFrame = ()
) -> DataFrame:
    """Rows of the chosen brands; no choice keeps all.

    A long choice is better given as a DataFrame with a ``brand`` column.
    """
    if isinstance(brands, DataFrame):
        return df.join(brands.select("brand").distinct(), "brand", "left_semi")
    return df.where(F.col("brand").isin(*brands)) if brands else df
