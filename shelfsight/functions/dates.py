"""Listing dates, ages and new/old flags."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfsight.config import NEW_LABEL, NEW_WITHIN_DAYS, OLD_LABEL

# Layouts tried after Spark's own ISO reading, in this order.
DATE_LAYOUTS = (
    "yyyy/M/d",
    "yyyy/M/d H:mm",
    "yyyy/M/d H:mm:ss",
    "yyyy.M.d",
    "M/d/yyyy",
    "yyyyMMdd",
)
MICROS_PER_DAY = 86_400_000_000


def parse_timestamp(c: Column) -> Column:
    """Text to timestamp; unreadable -> NULL."""
    text = F.trim(c)
    tries = [F.try_to_timestamp(text)]
    tries += [F.try_to_timestamp(text, F.lit(layout)) for layout in DATE_LAYOUTS]
    return F.coalesce(*tries)


def as_of_column(as_of: dt.date | dt.datetime | str | None) -> Column:
    """The moment ages are counted to; the clock only when none is given."""
    if as_of is None:
        return F.current_timestamp()
    return F.lit(str(as_of)).cast("timestamp")


def days_since(listed_at: Column, as_of: Column) -> Column:
    """Whole days from listing to ``as_of``, rounded down."""
    gap = F.unix_micros(as_of) - F.unix_micros(listed_at.cast("timestamp"))
    return F.floor(gap / MICROS_PER_DAY).cast("bigint")


def month_name(listed_at: Column) -> Column:
    """English month name."""
    return F.date_format(listed_at, "MMMM")


def newness(
    days_listed: Column, new_label: str = NEW_LABEL, old_label: str = OLD_LABEL
) -> Column:
    """New when listed for at most 90 days."""
    return F.when(days_listed <= NEW_WITHIN_DAYS, F.lit(new_label)).otherwise(
        F.lit(old_label)
    )
