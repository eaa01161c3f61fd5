"""The market brief: every headline of a market in one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.functions.numbers import cents, share_of
from shelfsight.operators.common import group
from shelfsight.operators.kpi import kpi_parts, newcomer_columns, rating_columns
from shelfsight.operators.prices import tiers_of

BRIEF_BRANDS = 5
BRIEF_ATTRIBUTES = 3

KEYS = ("_brand", "_price", "_attr")
KEY_TYPES = {"_brand": "string", "_price": "bigint", "_attr": "string"}
MARKET, BRAND, PRICE, ATTR = -1, 0, 1, 2  # What a row of the cube is about.


def market_cube(df: DataFrame, attribute: str | None, by: Sequence[str]) -> DataFrame:
    """The headline of each market, and of each of its brands, prices and attribute values.

    One scan and one shuffle for all grouping sets: each listing becomes a row per
    key, and these collapse again before they leave their task. ``_kind`` tells
    which key a row is for, by its place in ``KEYS``, or ``MARKET``. Spark's own
    grouping sets would do the same, but several readers of them share no shuffle.
    """
    named = attribute is not None and attribute in df.columns
    text = F.col(f"`{attribute}`").cast("string") if named else F.lit(None).cast("string")
    values = dict(zip(KEYS, (F.col("brand"), cents(F.col("price")), text), strict=True))
    headline = kpi_parts(df)
    measures = [headline[c].alias(c) for c in ("products", "total_units", "total_revenue", "avg_price")]
    measures += rating_columns(df)
    if "newness" in df.columns:
        measures += newcomer_columns(df)

    def row(kind: int) -> Column:
        mine = [v if i == kind else F.lit(None).cast(KEY_TYPES[k]) for i, (k, v) in enumerate(values.items())]
        return F.struct(F.lit(kind).alias("_kind"), *[m.alias(k) for k, m in zip(KEYS, mine, strict=True)])

    kinds = [MARKET, BRAND, PRICE, *([ATTR] if named else [])]
    keyed = df.select("*", F.inline(F.array(*[row(k) for k in kinds])))
    cube = keyed.groupBy(*by, "_kind", *KEYS).agg(*measures)
    # Filters on the kind stay above the generator, so that all readers see the same plan below.
    return cube.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in cube.columns]))))


def _leaders(cube: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per market: its own headline, and arrays ``_brands`` and ``_attrs`` of its leaders, best first."""
    kind, revenue = F.col("_kind"), F.col("total_revenue")
    key = F.when(kind == BRAND, F.col("_brand")).when(kind == ATTR, F.col("_attr"))
    rows = cube.where((kind != PRICE) & ((kind != ATTR) | F.col("_attr").isNotNull())).withColumn("_key", key)
    place = F.row_number().over(Window.partitionBy(*by, "_kind").orderBy(F.desc("total_revenue"), F.asc("_key")))
    ranked = rows.withColumn("_place", place).where(F.col("_place") <= max(BRIEF_BRANDS, BRIEF_ATTRIBUTES))
    entry = F.struct("_place", F.col("_key").alias("key"), revenue.alias("revenue"))

    def leaders(of: int, n: int) -> Column:
        mine = F.when((kind == of) & (F.col("_place") <= n), entry)
        return F.array_sort(F.collect_list(mine))

    kept = [c for c in cube.columns if c not in (*by, *KEYS, "_kind")]
    return group(ranked, by).agg(
        *[F.max(F.when(kind == MARKET, F.col(c))).alias(c) for c in kept],
        leaders(BRAND, BRIEF_BRANDS).alias("_brands"),
        leaders(ATTR, BRIEF_ATTRIBUTES).alias("_attrs"),
    )


def market_brief(
    df: DataFrame, attribute: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Totals, concentration, ratings, newcomers, price tiers and attributes.

    The listings are read once, into ``market_cube``. What is led by revenue and
    the price tiers each give one row per market, and the two are laid on top of
    each other.
    """
    cube = market_cube(df, attribute, by)
    priced = cube.where((F.col("_kind") == PRICE) & F.col("_price").isNotNull()).select(
        *by, F.col("_price").alias("value"), F.col("products").alias("n"), F.col("total_units").alias("units")
    )
    rows = _leaders(cube, by).unionByName(tiers_of(priced, by), allowMissingColumns=True)
    merged = group(rows, by).agg(*[F.max(c).alias(c) for c in rows.columns if c not in by])

    total = F.coalesce("total_revenue", F.lit(0.0))
    shares = F.transform("_brands", lambda b: F.format_string("%s(%.1f%%)", b["key"], share_of(b["revenue"], total)))
    led = F.aggregate("_brands", F.lit(0).cast("decimal(38,0)"), lambda s, b: (s + _cents(b["revenue"])).cast("decimal(38,0)"))
    shown = {
        "products": F.coalesce("products", F.lit(0)),
        "total_units": F.coalesce("total_units", F.lit(0)),
        "total_revenue": total,
        "avg_price": F.col("avg_price"),
        "cr5": share_of(F.coalesce(led, F.lit(0)).cast("double") / 100, total),
        "top_brands": F.array_join(shares, ", "),
        **{c: F.col(c) for c in ("avg_rating", "avg_reviews")},
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("low_rating_pct",)},
        **{c: F.col(c) for c in ("p25", "p75")},
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("low_pct", "mid_pct", "high_pct")},
    }
    if "newness" in df.columns:
        shown["new_products"] = F.coalesce("new_products", F.lit(0))
        shown["new_avg_revenue"] = F.col("new_avg_revenue")
        shown["new_share_pct"] = F.coalesce("new_share_pct", F.lit(0.0))
    if attribute is not None and attribute in df.columns:
        shown["top_attributes"] = F.array_join(F.transform("_attrs", lambda a: a["key"]), ", ")
    return merged.select(*by, *[c.alias(name) for name, c in shown.items()])


def _cents(revenue: Column) -> Column:
    return F.round(revenue * 100).try_cast("decimal(38,0)")
