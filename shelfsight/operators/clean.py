"""Typed tables from text exports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.config import NEW_LABEL_SHORT, UNKNOWN
from shelfsight.functions import dates, numbers, text
from shelfsight.operators.common import attach, group, is_text, number_in
from shelfsight.sources.headers import (
    HISTORY_NUMERIC_KEYS,
    HISTORY_PRICE_KEYS,
    existing,
    image_candidates,
    select_history,
)

MONEY_COLUMNS = (
    "monthly_revenue", "price", "fba_fee", "child_revenue", "shipping_fee",
)
PERCENT_COLUMNS = ("gross_margin", "review_rate", "growth_rate")
INTEGER_COLUMNS = (
    "monthly_units", "rating_count", "days_listed", "variation_count",
)
TEXT_COLUMNS = ("brand", "category", "fulfillment", "buybox_type", "title")
TEXT_ALWAYS = ("brand", "category")
MEASURED_COLUMNS = ("rating", "category_rank")


def clean_money(df: DataFrame) -> DataFrame:
    """Money columns as numbers, 0 where unreadable."""
    return df.withColumns(
        {
            c: numbers.currency(F.col(c))
            if is_text(df, c)
            else F.coalesce(number_in(df, c), F.lit(0.0))
            for c in existing(df, MONEY_COLUMNS)
        }
    )


def clean_percents(df: DataFrame, as_fraction: bool = False) -> DataFrame:
    """Percent columns as numbers, 0 where unreadable."""
    return df.withColumns(
        {
            c: numbers.percent(F.col(c), as_fraction)
            if is_text(df, c)
            else F.coalesce(number_in(df, c), F.lit(0.0))
            for c in existing(df, PERCENT_COLUMNS)
        }
    )


def clean_integers(df: DataFrame) -> DataFrame:
    """Count columns as BIGINT, 0 where unreadable."""
    return df.withColumns(
        {
            c: numbers.integer(F.col(c))
            if is_text(df, c)
            else F.coalesce(number_in(df, c).cast("bigint"), F.lit(0).cast("bigint"))
            for c in existing(df, INTEGER_COLUMNS)
        }
    )


def clean_measures(df: DataFrame) -> DataFrame:
    """Rating and rank as numbers; unlike the others these stay NULL."""
    return df.withColumns(
        {
            c: numbers.strict_number(F.col(c))
            for c in existing(df, MEASURED_COLUMNS)
            if is_text(df, c)
        }
    )


def fill_text(df: DataFrame) -> DataFrame:
    """'Unknown' for missing text; brand and category are made if absent."""
    filled = {
        c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))
        for c in existing(df, TEXT_COLUMNS)
    }
    absent = {c: F.lit(UNKNOWN) for c in TEXT_ALWAYS if c not in df.columns}
    return df.withColumns({**filled, **absent})


def listing_age(
    df: DataFrame,
    as_of: dt.date | dt.datetime | str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Date, age, month and new/old flag from ``listed_at``.

    The computed age replaces ``days_listed`` for the whole market when that
    column is absent or sums to 0.
    """
    if "listed_at" not in df.columns:
        return df
    if is_text(df, "listed_at"):
        df = df.withColumn("listed_at", dates.parse_timestamp(F.col("listed_at")))
    age = dates.days_since(F.col("listed_at"), dates.as_of_column(as_of))
    df = df.withColumn("days_listed_calc", age)
    fallback = F.coalesce(F.col("days_listed_calc"), F.lit(0).cast("bigint"))
    if "days_listed" in df.columns:
        given = group(df, by).agg(F.sum("days_listed").alias("_days_given"))
        df = (
            attach(df, given, by)
            .withColumn(
                "days_listed",
                F.when(
                    F.coalesce(F.col("_days_given"), F.lit(0)) == 0, fallback
                ).otherwise(F.col("days_listed")),
            )
            .drop("_days_given")
        )
    else:
        df = df.withColumn("days_listed", fallback)
    return df.withColumns(
        {
            "listed_month": dates.month_name(F.col("listed_at")),
            "newness": dates.newness(F.col("days_listed")),
        }
    )


def short_newness(df: DataFrame) -> DataFrame:
    """Add the short new/old label when the table has no flag yet."""
    if "newness" in df.columns or "days_listed" not in df.columns:
        return df
    flag = dates.newness(F.col("days_listed"), NEW_LABEL_SHORT)
    return df.withColumn("newness", flag)


def row_place(df: DataFrame) -> Column:
    """Where a row stands: its file, the block of it and its place among the rows read.

    Tables that do not come straight from files have only the last.
    """
    line = F.monotonically_increasing_id()
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return F.struct(line.alias("line"))
    return F.struct("_metadata.file_path", "_metadata.file_block_start", line.alias("line"))


def find_image_column(df: DataFrame) -> str | None:
    """First image-like column whose first non-null value is a web address.

    One job finds the first value of every candidate: each task keeps one value
    of each, with its place.
    """
    names = image_candidates([c for c in df.columns if c != "image_url"])
    if not names:
        return None
    read = df.select(row_place(df).alias("place"), *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    firsts = [
        F.min(F.when(F.col(f"c{i}").isNotNull(), F.struct("place", f"c{i}")))[f"c{i}"].alias(f"c{i}") for i in range(len(names))
    ]
    found = read.agg(*firsts).first()
    return next((c for c, first in zip(names, found, strict=True) if (first or "").startswith("http")), None)


def with_image_url(df: DataFrame, column: str | None = None) -> DataFrame:
    """Add ``image_url``: the given column, a detected one, or built from id."""
    chosen = column or find_image_column(df)
    if chosen:
        return df.withColumn("image_url", F.col(f"`{chosen}`"))
    if "asin" in df.columns:
        return df.withColumn("image_url", text.image_url(F.col("asin")))
    return df.withColumn("image_url", F.lit(None).cast("string"))


def clean_listings(
    df: DataFrame,
    as_of: dt.date | dt.datetime | str | None = None,
    by: Sequence[str] = (),
    growth_as_fraction: bool = False,
    keep_raw: bool = False,
) -> DataFrame:
    """All cleaning steps over a table with canonical names.

    ``keep_raw`` keeps each text column that becomes a number as ``<name>_raw``
    in the same row, so later checks need no second scan.
    """
    if keep_raw:
        changed = existing(
            df,
            (*MONEY_COLUMNS, *PERCENT_COLUMNS, *INTEGER_COLUMNS, "listed_at"),
        )
        df = df.withColumns({f"{c}_raw": F.col(c).cast("string") for c in changed})
    df = clean_integers(clean_percents(clean_money(df), growth_as_fraction))
    return fill_text(listing_age(clean_measures(df), as_of, by))


def clean_history(df: DataFrame) -> DataFrame:
    """A history export under its keys with numeric columns as numbers.

    Unreadable numbers stay NULL. Price columns also lose their currency sign;
    each keeps its text as ``<key>_raw``.
    """
    keyed = select_history(df)
    have = existing(keyed, HISTORY_NUMERIC_KEYS)
    raw = {
        f"{c}_raw": F.col(c).cast("string")
        for c in have
        if c in HISTORY_PRICE_KEYS
    }
    clean = {
        c: numbers.strict_number(
            F.regexp_replace(F.col(c).cast("string"), r"[^0-9.\-]", "")
        )
        if c in HISTORY_PRICE_KEYS and is_text(keyed, c)
        else numbers.loose_number(F.col(c))
        if is_text(keyed, c)
        else number_in(keyed, c)
        for c in have
    }
    return keyed.withColumns({**raw, **clean})
