"""Listing table joined with its price history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.functions.numbers import strip
from shelfsight.functions.text import SPACES

# History rows of one id that a task may join; more are split.
ROWS_PER_TASK = 1_000_000
# Most ids that are split, and ids that the sketch of each task keeps count of.
HOT_IDS, TRACKED_IDS = 1_000, 65_536
# Tasks over which rows without an id are spread.
NO_ID_PARTS = 1_024


def fill_parent(history: DataFrame) -> DataFrame:
    """A blank or missing parent becomes the listing's own id."""
    if "parent_asin" not in history.columns:
        return history
    parent = F.col("parent_asin")
    blank = parent.isNull() | ~parent.rlike(rf"[^{SPACES}]")
    return history.withColumn(
        "parent_asin", F.when(blank, F.col("asin")).otherwise(parent)
    )


def hot_ids(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> Column:
    """A map from each id with more than ``rows_per_task`` rows to the tasks it calls for, as a scalar subquery.

    A sketch of frequent items counts the ids: every task keeps a bounded number
    of them, and sketches are merged. It never counts too few, and an id that it
    names is one of the table's.
    """
    top = df.select(F.col(key).alias("id")).agg(
        F.expr(f"approx_top_k(id, {HOT_IDS}, {TRACKED_IDS})").alias("top")
    )
    many = F.filter("top", lambda t: t["item"].isNotNull() & (t["count"] > rows_per_task))
    tasks = F.transform(many, lambda t: F.struct(t["item"], F.ceil(t["count"] / rows_per_task)))
    return top.select(F.map_from_entries(tasks)).scalar()


def merge_history(
    listings: DataFrame,
    history: DataFrame,
    suffixes: tuple[str, str] = ("", "_history"),
    key: str = "asin",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Left join on the trimmed listing id; one-to-many matches fan out.

    Columns both sides have are told apart by ``suffixes``. A NULL id matches
    nothing. It is one left join that reads each side once; a sketch reads the
    ids of the history before. Adaptive execution splits an id that is hot among
    the listings. One that is hot in the history is split here: its rows are
    dealt to several tasks by hash of their content, and its listings go to each.
    """
    if key not in history.columns:
        raise ValueError(f"the history table has no {key!r} column")
    shared = (set(listings.columns) & set(history.columns)) - {key}

    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.toDF(*[c + suffix if c in shared else c for c in df.columns])

    left = renamed(listings, suffixes[0])
    has_id = F.col(key).isNotNull()
    right = history.where(has_id).withColumn(key, F.coalesce(strip(F.col(key)), F.lit("")))
    hot = hot_ids(right, key, rows_per_task)
    right = renamed(fill_parent(right), suffixes[1])
    columns = [*left.columns, *[c for c in right.columns if c != key]]

    left = left.withColumns({key: strip(F.col(key)), "_tasks": F.coalesce(hot[strip(F.col(key))], F.lit(1))})
    others = [F.col(f"`{c}`") for c in left.columns if c not in (key, "_tasks")]
    spread = F.pmod(F.xxhash64(F.lit(0), *others), F.lit(NO_ID_PARTS))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("_tasks") - 1)
    left = left.withColumn("_task", F.explode(F.when(has_id, every).otherwise(F.array(spread))))
    content = F.xxhash64(*[f"`{c}`" for c in right.columns])
    right = right.withColumn("_task", F.pmod(content, F.coalesce(hot[F.col(key)], F.lit(1))))
    joined = left.join(right.withColumn("_found", F.lit(True)), [key, "_task"], "left")
    # A split id is in the history: where one of its tasks has no row of it, another has.
    kept = joined.where(F.col("_found").isNotNull() | (F.col("_tasks") == 1))
    return kept.select(*[F.col(f"`{c}`") for c in columns])
