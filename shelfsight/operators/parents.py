"""Variants grouped under their parent product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.config import INDEPENDENT_PARENT, UNKNOWN, UNKNOWN_TITLE
from shelfsight.functions.bands import price_band
from shelfsight.functions.text import core_title
from shelfsight.operators.common import group, rounded_avg
from shelfsight.sources.headers import existing, first_existing

PARENT_COLUMNS = ("parent_asin", "Parent ASIN", "父ASIN", "Parent", "父体")
TITLE_COLUMNS = ("title", "Title", "Product Name", "标题", "Name")


def with_parent(df: DataFrame) -> DataFrame:
    """Add ``parent_id`` and ``is_independent``.

    An explicit parent column is used when there is one. Otherwise listings
    with the same brand, core title and price band count as one product.
    """
    explicit = existing(df, PARENT_COLUMNS)
    if explicit:
        parent = F.col(f"`{explicit[0]}`")
        return df.withColumns(
            {
                "parent_id": F.coalesce(parent, F.lit(INDEPENDENT_PARENT)),
                "is_independent": parent.isNull(),
            }
        )
    if existing(df, TITLE_COLUMNS):
        core = core_title(first_existing(df, TITLE_COLUMNS, F.lit(None)))
    else:
        core = first_existing(df, ["asin"], F.lit(UNKNOWN))
    prices = existing(df, ("price", "Price"))
    band = (
        price_band(F.col(prices[0]).try_cast("double"))
        if prices
        else F.lit(UNKNOWN_TITLE)
    )
    brand = first_existing(df, ("brand", "Brand"), F.lit(UNKNOWN))
    return df.withColumns(
        {
            "parent_id": F.concat_ws(
                " | ", F.coalesce(brand, F.lit(UNKNOWN_TITLE)), core, band
            ),
            "is_independent": F.lit(False),
        }
    )


def parent_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Variants, units, best rank, rating, reviews and stock-outs per parent."""
    rules = {
        "asin": F.count("asin").alias("variants"),
        "monthly_units": F.coalesce(F.sum("monthly_units"), F.lit(0)).alias("units"),
        "category_rank": F.min("category_rank").alias("best_rank"),
        "rating": rounded_avg(F.col("rating"), 2).alias("avg_rating"),
        "rating_count": F.sum("rating_count").alias("reviews"),
        "oos_90": rounded_avg(F.col("oos_90"), 2).alias("avg_oos"),
    }
    return df.groupBy(*by, "parent_id").agg(
        *[rules[c] for c in existing(df, rules)]
    )


def parent_kpis(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of parents, parents with one variant, mean variants."""
    return group(stats, by).agg(
        F.count(F.lit(1)).alias("parents"),
        F.count_if(F.col("variants") == 1).alias("single_variant"),
        F.avg("variants").alias("avg_variants"),
    )
