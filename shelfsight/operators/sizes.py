"""Parcel sizes: bands, extents, limits and leaders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.config import SizeLimits
from shelfsight.functions.bands import size_band, step_bin
from shelfsight.functions.numbers import bought_count, digits_price, share_of
from shelfsight.operators.common import (
    attach,
    group,
    histogram,
    money_sum,
    number_in,
    quantiles_of,
    top_n,
    total_money,
    with_once,
)

SIDES = ("pkg_l", "pkg_w", "pkg_h")
LENGTH_STEP = 5


def sized(df: DataFrame) -> DataFrame:
    """Rows with all three sides and a unit count, plus derived columns.

    Units come from the sales text; revenue is units times price.
    """
    text_price = "price_curr_raw" if "price_curr_raw" in df.columns else "price_curr"
    price = (
        digits_price(F.col(text_price)) if text_price in df.columns else F.lit(0.0)
    )
    read = {
        **{c: number_in(df, c) for c in SIDES},
        "units": bought_count(F.col("sales_text"), on_fail=None),
        "unit_price": price,
    }
    return (
        with_once(df, read)
        .dropna(subset=[*SIDES, "units"])
        .withColumn("longest_side", F.greatest(*SIDES))
        .withColumn("est_revenue", F.col("units") * F.col("unit_price"))
        .withColumn("size_band", size_band(F.col("longest_side")))
    )


def size_bands(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Listings, mean units and revenue of each size band."""
    bands = (
        df.where(F.col("size_band").isNotNull())
        .groupBy(*by, "size_band")
        .agg(
            F.count("asin").alias("listings"),
            F.avg("units").alias("avg_units"),
            money_sum(F.col("est_revenue")).alias("revenue"),
        )
    )
    total = group(bands, by).agg(total_money(F.col("revenue")).alias("_total"))
    return (
        attach(bands, total, by)
        .withColumn("share_pct", share_of(F.col("revenue"), F.col("_total")))
        .drop("_total")
    )


def length_bins(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Units sold per 5 cm of parcel length."""
    lo = F.col("length_bin")
    return (
        df.withColumn("length_bin", step_bin(F.col("pkg_l"), LENGTH_STEP))
        .groupBy(*by, "length_bin")
        .agg(F.sum("units").alias("units"))
        .withColumn(
            "label",
            F.concat(
                lo.cast("string"), F.lit("-"),
                (lo + LENGTH_STEP).cast("string"), F.lit("cm"),
            ),
        )
    )


def size_compliance(
    df: DataFrame, limits: SizeLimits = SizeLimits(), by: Sequence[str] = ()
) -> DataFrame:
    """How many parcels exceed each limit."""
    checks = {
        "length": F.col("pkg_l") > limits.length,
        "width": F.col("pkg_w") > limits.width,
        "height": F.col("pkg_h") > limits.height,
    }
    rows = F.count(F.lit(1))
    return group(df, by).agg(
        rows.alias("products"),
        *[F.count_if(c).alias(f"over_{k}") for k, c in checks.items()],
        *[
            share_of(F.count_if(c), rows).alias(f"over_{k}_pct")
            for k, c in checks.items()
        ],
    )


def size_extent(
    df: DataFrame, limits: SizeLimits = SizeLimits(), by: Sequence[str] = ()
) -> DataFrame:
    """Axis ends that show 99 % of the parcels and the limits."""
    sides = F.array(*[F.struct(F.lit(c).alias("_side"), F.col(c).alias("_size")) for c in SIDES[:2]])
    each = df.select(*by, F.inline(sides))
    keys = [*by, "_side"]
    ends = quantiles_of(histogram(each, F.col("_size"), keys), {"_end": 0.99}, keys, split=True)
    wide = group(ends, by).agg(
        *[F.max(F.when(F.col("_side") == c, F.col("_end"))).alias(to) for c, to in zip(SIDES, ("_l", "_w"))]
    )
    return wide.select(
        *by,
        F.greatest(F.col("_l") * 1.1, F.lit(limits.length * 1.05)).alias("max_length"),
        F.greatest(F.col("_w") * 1.1, F.lit(limits.width * 1.05)).alias("max_width"),
    )


def size_leaders(df: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Best-selling sized listings, with the brand and parent they belong to."""
    leaders = top_n(df, [F.desc("units"), F.asc("asin")], n, by)
    shown = [c for c in ("asin", "title", "brand", "parent_asin") if c in df.columns]
    return leaders.select(*by, *shown, "units", "est_revenue", *SIDES)


def leader_bound(leaders: DataFrame) -> DataFrame:
    """Largest unit count among the leaders, 100 when there are none."""
    bound = F.coalesce(F.max("units").cast("bigint"), F.lit(100).cast("bigint"))
    return leaders.agg(bound.alias("max_units"))
