"""Opportunity score: demand, price, competition and growth in one number."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.config import (
    TAG_BEST_SELLER,
    TAG_FEW_SELLERS,
    TAG_FREQUENT_SALES,
    TAG_IMPROVABLE,
    TAG_LOW_PRICE,
    TAG_NEW_STAR,
    TAG_OUT_OF_STOCK,
    TAG_PLATFORM_SELLS,
    ScoreConfig,
)
from shelfsight.functions import numbers
from shelfsight.operators.common import group, number_in, top_n, with_once

INPUTS = (
    "sales_text", "rank_drops", "price_curr", "rating_count", "rating_val",
    "oos_90", "share_amz_90", "offers_fba", "offers_fbm",
)
MISSING_REVIEWS = 9999.0


def _inputs(
    df: DataFrame, columns: Mapping[str, str], legacy_sales: bool
) -> dict[str, Column]:
    """Input per key; an absent column is 0, which is not the same as NULL."""
    found = {
        key: F.col(f"`{columns.get(key, key)}`")
        for key in INPUTS
        if columns.get(key, key) in df.columns
    }
    zero = F.lit(0.0)

    def number(key: str, missing: float | None) -> Column:
        if key not in found:
            return zero
        value = number_in(df, columns.get(key, key))
        return value if missing is None else F.coalesce(value, F.lit(missing))

    return {
        "sales": numbers.bought_count(found["sales_text"], legacy=legacy_sales)
        if "sales_text" in found
        else zero,
        "share": numbers.share_pct(found["share_amz_90"])
        if "share_amz_90" in found
        else zero,
        "drops": number("rank_drops", 0.0),
        "price": number("price_curr", 0.0),
        "reviews": number("rating_count", MISSING_REVIEWS),
        "rating": number("rating_val", 0.0),
        "oos": number("oos_90", 0.0),
        "offers": number("offers_fba", None) + number("offers_fbm", None),
    }


def opportunity_score(
    df: DataFrame,
    config: ScoreConfig = ScoreConfig(),
    columns: Mapping[str, str] | None = None,
    legacy_sales: bool = False,
) -> DataFrame:
    """Add score, tags and the numbers behind them to every row.

    ``columns`` maps input keys to column names that differ from them. The
    work is one projection: no shuffle and no Python per row.
    """
    inputs = _inputs(df, columns or {}, legacy_sales)
    prepared = df.withColumns({f"_{k}": c for k, c in inputs.items()})
    sales, drops, price = F.col("_sales"), F.col("_drops"), F.col("_price")
    reviews, rating, oos = F.col("_reviews"), F.col("_rating"), F.col("_oos")
    share, offers = F.col("_share"), F.col("_offers")

    sells, drops_only = sales > 0, (sales <= 0) & (drops > 0)
    demand = (
        F.when(sells, F.least(F.lit(100.0), sales / config.target_sales * 100))
        .when(drops_only, F.least(F.lit(100.0), drops / 30 * 80))
        .otherwise(0.0)
    )
    in_range = price.between(config.price_min, config.price_max)
    off_range = ~in_range & (price > 0)
    distance = F.least(
        F.abs(price - config.price_min), F.abs(price - config.price_max)
    )
    price_fit = (
        F.when(in_range, 100.0)
        .when(off_range, F.greatest(F.lit(0.0), 100 - distance * 3))
        .otherwise(0.0)
    )
    open_field = reviews < config.max_reviews
    few_reviews = F.when(
        open_field, 100 - reviews / config.max_reviews * 50
    ).otherwise(0.0)
    platform_sells = share > 50
    penalty = F.when(share > 80, 0.1).when(platform_sells, 0.5).otherwise(1.0)
    improvable = ((sales > config.target_sales * 0.5) | (drops > 45)) & (
        rating.between(3.0, 3.9)
    )
    growth = F.least(
        F.lit(100.0),
        F.when(oos > 15, 40.0).otherwise(0.0) + F.when(improvable, 60.0).otherwise(0.0),
    )
    score = (
        demand * config.w_sales
        + price_fit * config.w_profit
        + few_reviews * penalty * config.w_comp
        + growth * config.w_growth
    ) / config.total_weight
    tags = F.array(
        F.when(sells & (sales > 1000), TAG_BEST_SELLER),
        F.when(drops_only & (drops > 60), TAG_FREQUENT_SALES),
        F.when(off_range & (price < 10), TAG_LOW_PRICE),
        F.when(open_field & (reviews < 50), TAG_NEW_STAR),
        F.when(platform_sells, TAG_PLATFORM_SELLS),
        F.when((offers > 0) & (offers < 5), TAG_FEW_SELLERS),
        F.when(
            oos > 15,
            F.concat(F.lit(TAG_OUT_OF_STOCK), numbers.whole_share(oos), F.lit("%")),
        ),
        F.when(improvable, TAG_IMPROVABLE),
    )
    scored = with_once(
        prepared,
        {
            "score": score.cast("int"),
            "tags": F.array_join(F.slice(F.array_compact(tags), 1, 3), " "),
            "score_units": F.when(sells, sales.cast("bigint")).otherwise(0),
            "score_price": price,
            "score_rating": rating,
            "score_share": share,
        },
    )
    return scored.drop(*[c for c in prepared.columns if c not in df.columns])


def opportunities(scored: DataFrame) -> DataFrame:
    """Rows with a positive score."""
    return scored.where(F.col("score") > 0)


def top_opportunities(
    scored: DataFrame, n: int = 50, by: Sequence[str] = ()
) -> DataFrame:
    """Best-scored rows, the id deciding ties."""
    return top_n(
        opportunities(scored), [F.desc("score"), F.asc("asin")], n, by
    )


def opportunity_summary(
    scored: DataFrame, config: ScoreConfig = ScoreConfig(), by: Sequence[str] = ()
) -> DataFrame:
    """Rows analysed, rows kept and the weights in percent."""
    return group(scored, by).agg(
        F.count(F.lit(1)).alias("analysed"),
        F.count_if(F.col("score") > 0).alias("kept"),
        *[F.lit(v).alias(f"{k}_pct") for k, v in config.weight_shares().items()],
    )
