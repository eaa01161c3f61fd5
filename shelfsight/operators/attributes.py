"""Sales by the values of one product attribute."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.functions.numbers import cents
from shelfsight.operators.common import (
    cents_sum,
    histogram,
    money_avg,
    money_sum,
    number_in,
    quantiles_of,
    top_n,
    with_once,
)

MAX_NUMERIC_GROUPS = 50
MAX_TEXT_GROUPS = 15


def is_numeric_attribute(df: DataFrame, attribute: str) -> bool:
    """Whether any value reads as a number; stops at the first that does."""
    number = number_in(df, attribute)
    return not df.where(number.isNotNull()).select(F.lit(1)).isEmpty()


def prepare_attribute(df: DataFrame, attribute: str, numeric: bool) -> DataFrame:
    """Add ``attr``: whole positive numbers (half to even), or the text."""
    if numeric:
        rounded = with_once(df, {"attr": F.bround(number_in(df, attribute), 0)})
        return rounded.where(F.col("attr") > 0)
    named = with_once(df, {"attr": F.col(f"`{attribute}`").cast("string")})
    return named.where(F.col("attr").isNotNull())


def attribute_groups(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Units, revenue, growth, price and listings of each attribute value."""
    growth = (
        F.avg(F.col("growth_rate") * 100) if "growth_rate" in df.columns else F.lit(0.0)
    )
    return df.groupBy(*by, "attr").agg(
        F.coalesce(F.sum("monthly_units"), F.lit(0)).alias("units"),
        money_sum(F.col("monthly_revenue")).alias("revenue"),
        growth.alias("avg_growth_pct"),
        money_avg(F.col("price")).alias("avg_price"),
        F.count("asin").alias("listings"),
    )


def _same(by: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])


def _decided(texts: DataFrame, attribute: str, by: Sequence[str]) -> DataFrame:
    """Rows per market and raw value, each under the ``attr`` that its market makes of it.

    ``_numeric`` says whether any value of the market reads as a number; then
    ``attr`` is the whole positive number as text, and other values go. Only
    such rows, never listings, meet the kind of their market.
    """
    number = number_in(texts, attribute)
    kinds = texts.groupBy(*by).agg(
        F.coalesce(F.bool_or(number.isNotNull()), F.lit(False)).alias("_numeric")
    )
    kinds = kinds.toDF(*[f"_of_{c}" for c in by], "_numeric")
    rows = texts.withColumn("_number", F.bround(number, 0)).join(kinds, _same(by))
    whole = F.coalesce(
        F.col("_number").try_cast("decimal(38,0)").cast("string"),
        F.col("_number").cast("string"),
    )
    text = F.col(f"`{attribute}`").cast("string")
    rows = rows.withColumn(
        "attr", F.when(~F.col("_numeric"), text).when(F.col("_number") > 0, whole)
    )
    dropped = [f"_of_{c}" for c in by]
    return rows.where(F.col("attr").isNotNull()).drop("_number", *dropped)


def _groups_per_market(df: DataFrame, attribute: str, by: Sequence[str]) -> DataFrame:
    """``attribute_groups`` per market and attribute, each market by its own kind; ``_numeric`` beside them."""
    growth = F.col("growth_rate") * 100 if "growth_rate" in df.columns else F.lit(0.0)
    texts = df.groupBy(*by, F.col(f"`{attribute}`").alias(attribute)).agg(
        F.sum("monthly_units").alias("_units"),
        cents_sum(F.col("monthly_revenue")).alias("_cents"),
        F.sum(growth).alias("_growth"),
        F.count(growth).alias("_grown"),
        cents_sum(F.col("price")).alias("_price"),
        F.count("price").alias("_priced"),
        F.count("asin").alias("_listings"),
    )
    cents_of = F.sum(F.col("_cents").cast("decimal(38,0)")).cast("double")
    price = F.sum(F.col("_price").cast("decimal(38,0)")).cast("double")
    return _decided(texts, attribute, by).groupBy(*by, "_numeric", "attr").agg(
        F.coalesce(F.sum("_units"), F.lit(0)).alias("units"),
        (F.coalesce(cents_of, F.lit(0.0)) / 100).alias("revenue"),
        F.try_divide(F.sum("_growth"), F.sum("_grown")).alias("avg_growth_pct"),
        F.try_divide(price / 100, F.sum("_priced")).alias("avg_price"),
        F.sum("_listings").alias("listings"),
    )


def _leaders_per_market(
    groups: DataFrame, by: Sequence[str], most_numeric: int, most_texts: int
) -> DataFrame:
    value = F.when(F.col("_numeric"), F.col("attr").cast("double"))
    order = [F.desc("revenue"), value.asc(), F.asc("attr")]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = groups.withColumn("_place", place)
    most = F.when(F.col("_numeric"), most_numeric).otherwise(most_texts)
    return ranked.where(
        (F.col("_place") <= max(most_numeric, most_texts)) & (F.col("_place") <= most)
    ).drop("_place")


def top_attributes(
    df: DataFrame,
    attribute: str,
    numeric: bool | None = None,
    by: Sequence[str] = (),
    most_numeric: int = MAX_NUMERIC_GROUPS,
    most_texts: int = MAX_TEXT_GROUPS,
) -> DataFrame:
    """Leading attribute values: ``most_numeric`` ones by value, or ``most_texts`` texts.

    Without ``numeric`` each market is numeric if any of its own values reads as
    a number; with ``by``, ``attr`` is then text in all markets.
    """
    if numeric is None and by:
        leaders = _leaders_per_market(
            _groups_per_market(df, attribute, by), by, most_numeric, most_texts
        )
        value = F.when(F.col("_numeric"), F.col("attr").cast("double"))
        return leaders.orderBy(*by, value, F.desc("revenue"), "attr").drop("_numeric")
    if numeric is None:
        numeric = is_numeric_attribute(df, attribute)
    groups = attribute_groups(prepare_attribute(df, attribute, numeric), by)
    n = most_numeric if numeric else most_texts
    leaders = top_n(groups, [F.desc("revenue"), F.asc("attr")], n, by)
    return leaders.orderBy(*by, "attr") if numeric else leaders


def attribute_price_box(
    df: DataFrame, attribute: str, numeric: bool | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Price minimum, quartiles and maximum of each leading attribute value.

    ``numeric`` and the type of ``attr`` are as in ``top_attributes``.
    """
    if numeric is None and by:
        groups = _groups_per_market(df, attribute, by)
        leaders = _leaders_per_market(groups, by, MAX_NUMERIC_GROUPS, MAX_TEXT_GROUPS)
        raw = histogram(df, cents(F.col("price")), [*by, attribute])
        values = _decided(raw, attribute, by).groupBy(*by, "attr", "value")
        # Several texts can stand for one number.
        prices = values.agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    else:
        if numeric is None:
            numeric = is_numeric_attribute(df, attribute)
        prepared = prepare_attribute(df, attribute, numeric)
        leaders = top_attributes(df, attribute, numeric, by)
        prices = histogram(prepared, cents(F.col("price")), [*by, "attr"])
    leaders = leaders.select(*by, "attr")
    if by:
        leaders = leaders.toDF(*[f"_of_{c}" for c in by], "_attr")
        same = (F.col("attr") == F.col("_attr")) & _same(by)
        prices = prices.join(leaders, same, "left_semi")
    else:
        # A limit keeps this at 50 rows or fewer.
        prices = prices.join(F.broadcast(leaders), "attr", "left_semi")
    box = quantiles_of(
        prices,
        {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0},
        [*by, "attr"],
    )
    return box.select(
        *by, "attr",
        *[(F.col(c) / 100).alias(c) for c in ("low", "q1", "median", "q3", "high")],
    ).orderBy(*by, "attr")


def top_attribute_values(
    df: DataFrame, attribute: str, n: int = 3, by: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` attribute values with most revenue."""
    named = df.withColumn("attr", F.col(f"`{attribute}`").cast("string"))
    earned = (
        named.where(F.col("attr").isNotNull())
        .groupBy(*by, "attr")
        .agg(money_sum(F.col("monthly_revenue")).alias("revenue"))
    )
    return top_n(earned, [F.desc("revenue"), F.asc("attr")], n, by)
