"""Row-level views of the listing table: leaders and chart rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.functions.text import short_title
from shelfsight.operators.common import top_n
from shelfsight.sources.headers import existing


def growth_pct(df: DataFrame) -> Column:
    """Growth in percent, 0 when the table has no growth column."""
    return F.col("growth_rate") * 100 if "growth_rate" in df.columns else F.lit(0.0)


def marker_size(value: Column, floor: float) -> Column:
    """Value with a lower bound, so that no chart marker vanishes."""
    return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(floor).cast("double"))


def top_listings(df: DataFrame, n: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Listings with most revenue, with their place and a short title."""
    order = [F.desc("monthly_revenue"), F.asc("asin")]
    leaders = top_n(df, order, n, by)
    # Only the n leaders of each market are numbered.
    place = F.row_number().over(
        Window.partitionBy(*[F.col(c) for c in by]).orderBy(*order)
    )
    shown = existing(
        df, ("asin", "monthly_revenue", "monthly_units", "price", "image_url")
    )
    titles = (
        [short_title(F.col("title")).alias("short_title")]
        if "title" in df.columns
        else []
    )
    return leaders.select(*by, place.alias("place"), *shown, *titles)


def growth_leaders(df: DataFrame, n: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Fastest-growing listings."""
    grown = df.withColumn("growth_pct", growth_pct(df))
    leaders = top_n(grown, [F.desc_nulls_last("growth_pct"), F.asc("asin")], n, by)
    shown = existing(
        grown, ("image_url", "asin", "monthly_units", "growth_pct", "price")
    )
    return leaders.select(*by, *shown)


def growth_matrix(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Growth against units for every listing, with marker sizes."""
    shown = existing(df, ("asin", "title", "brand", "price", "days_listed"))
    return df.select(
        *by,
        *shown,
        F.coalesce("monthly_units", F.lit(0)).alias("monthly_units"),
        F.coalesce("monthly_revenue", F.lit(0.0)).alias("monthly_revenue"),
        growth_pct(df).alias("growth_pct"),
        marker_size(F.col("monthly_revenue"), 100).alias("marker"),
    )


def launch_timeline(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Listing date against revenue for every listing, with marker sizes."""
    return df.select(
        *by,
        *existing(df, ("asin", "brand", "listed_at", "monthly_revenue")),
        F.coalesce("monthly_units", F.lit(0)).alias("monthly_units"),
        marker_size(F.col("monthly_units").cast("double"), 10).alias("marker"),
    )


def out_of_stock(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ranked listings that were out of stock some of the time."""
    oos = F.coalesce(F.col("oos_90"), F.lit(0.0))
    rank = F.coalesce(F.col("rank_curr"), F.lit(0.0))
    shown = existing(df, ("asin", "brand"))
    return df.where((oos > 0) & (rank > 0)).select(*by, *shown, "rank_curr", "oos_90")
