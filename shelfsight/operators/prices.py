"""Price bins, price tiers and histograms of one measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.functions.bands import range_label
from shelfsight.functions.numbers import cents, share_of
from shelfsight.operators.common import (
    attach,
    cents_sum,
    equal_width_bins,
    histogram,
    quantiles_of,
    span_below,
    top_n,
)

PRICE_BINS = 10


def price_bins(
    df: DataFrame, price: str, revenue: str, by: Sequence[str] = ()
) -> DataFrame:
    """Mean revenue and listing count in ten equal price bins.

    Prices above the 99th percentile are left out. Everything after the first
    aggregation works on one row per distinct price; all that the bins need to
    know of their market is one row, attached once.
    """
    priced = df.where((F.col(price) > 0) & (F.col(revenue) > 0))
    counted = histogram(
        priced,
        cents(F.col(price)),
        by,
        revenue_cents=cents_sum(F.col(revenue)),
        ids=F.count("asin"),
    )
    span = span_below(counted, 0.99, by).select(
        *by,
        F.floor(F.col("least") / 100).alias("_lo"),
        F.ceil(F.col("most") / 100).alias("_hi"),
        F.col("most").alias("_most"),
        F.col("rows").alias("_rows"),
    )
    # Bin numbers come from whole cents: a price on an edge stays below it.
    width = F.when(F.col("_hi") == F.col("_lo"), PRICE_BINS).otherwise(
        F.col("_hi") - F.col("_lo")
    )
    above = F.col("value").cast("double") - F.col("_lo").cast("double") * 100
    place = F.greatest(
        F.ceil(above * PRICE_BINS / (width.cast("double") * 100)), F.lit(1)
    )
    lo = F.col("_lo") + (F.col("bin") - 1) * width / PRICE_BINS
    hi = F.col("_lo") + F.col("bin") * width / PRICE_BINS
    return (
        attach(counted, span, by)
        .where((F.col("value") <= F.col("_most")) & (F.col("_rows") > 1))
        .withColumn("bin", place)
        .groupBy(*by, "bin", lo.alias("bin_lo"), hi.alias("bin_hi"))
        .agg(
            (F.sum("revenue_cents").cast("double") / 100 / F.sum("n")).alias(
                "avg_revenue"
            ),
            F.sum("ids").alias("listings"),
        )
        .withColumn("price_range", range_label(F.col("bin_lo"), F.col("bin_hi")))
    )


def best_price_bin(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The bin with the highest mean revenue, the cheaper one on a tie."""
    return top_n(bins, [F.desc("avg_revenue"), F.asc("bin")], 1, by)


def price_tiers(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quartile prices and the share of units in the low, mid and high tier."""
    counted = histogram(
        df, cents(F.col("price")), by, units=F.sum("monthly_units")
    )
    return tiers_of(counted, by)


def tiers_of(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Price tiers of a histogram of cents with ``units``."""
    quarters = quantiles_of(counted, {"_p25": 0.25, "_p75": 0.75}, by, ["units"])
    total, low, usual = F.col("all_units"), F.col("_p25_units"), F.col("_p75_units")
    return quarters.select(
        *by,
        (F.col("_p25") / 100).alias("p25"),
        (F.col("_p75") / 100).alias("p75"),
        share_of(low, total).alias("low_pct"),
        share_of(usual - low, total).alias("mid_pct"),
        share_of(total - usual, total).alias("high_pct"),
    )


def measure_histogram(
    df: DataFrame, column: str, bins: int = 20, by: Sequence[str] = ()
) -> DataFrame:
    """Counts of a measure in equal-width bins."""
    return equal_width_bins(histogram(df, F.col(column), by), bins, by)
