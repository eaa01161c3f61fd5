"""Attribute text as long rows or as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.config import PARAM_PREFIX
from shelfsight.functions.text import attribute_map


def with_params(df: DataFrame) -> DataFrame:
    """Add ``params``: the attribute text as a map."""
    return df.withColumn("params", attribute_map(F.col("params_text")))


def params_long(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per attribute: the key columns, ``key`` and ``value``."""
    return with_params(df).select(*keys, F.explode("params"))


def common_keys(df: DataFrame, min_share: float = 0.05) -> list[str]:
    """Attribute names present in at least ``min_share`` of the rows.

    Each such name uses up min_share of the rows, so there are at most
    (attributes per row) / min_share of them however large the table is.
    """
    # One counting pass: the row count rides along as the NULL key.
    per_row = F.concat(
        F.array(F.lit(None).cast("string")),
        F.map_keys(attribute_map(F.col("params_text"))),
    )
    counted = (
        df.select(F.explode(per_row).alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    total = counted.where(F.col("key").isNull()).select("rows").scalar()
    kept = counted.where(
        F.col("key").isNotNull() & (F.col("rows") >= total * F.lit(min_share))
    )
    return sorted(row.key for row in kept.select("key").collect())


def params_wide(
    df: DataFrame, min_share: float = 0.05, keys: list[str] | None = None
) -> DataFrame:
    """One column per common attribute, read from the map without a pivot."""
    names = common_keys(df, min_share) if keys is None else keys
    return with_params(df).select(
        *df.columns,
        *[F.col("params")[k].alias(f"{PARAM_PREFIX}{k}") for k in names],
    )
