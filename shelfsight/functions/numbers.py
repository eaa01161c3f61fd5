"""Dirty text to numbers. Every function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's own cast also takes '1d' and 'Infinity'; exports never mean those.
PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Every character Python's str.strip() removes, for use with btrim.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Drop leading and trailing whitespace, Unicode spaces included."""
    return F.btrim(c, F.lit(WHITESPACE))


def strict_number(c: Column) -> Column:
    """Number when the whole text is one, else NULL (never NaN)."""
    text = c.cast("string")
    return F.when(text.rlike(PLAIN_NUMBER), F.trim(text).try_cast("double"))


def _without(text: Column, mark: str) -> Column:
    """Text without a mark; cheap where the mark does not occur."""
    return F.replace(text, F.lit(mark), F.lit(""))


def currency(c: Column) -> Column:
    """'$1,200.50' -> 1200.5; anything unreadable -> 0."""
    kept = F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "")
    return F.coalesce(strict_number(kept), F.lit(0.0))


def loose_number(c: Column) -> Column:
    """Drop '%' and ',' and read the rest; unreadable -> NULL."""
    return strict_number(_without(_without(c.cast("string"), "%"), ","))


def percent(c: Column, as_fraction: bool = False) -> Column:
    """'35%' -> 35.0; unreadable -> 0. With ``as_fraction``, '35%' -> 0.35."""
    value = loose_number(c)
    if as_fraction:
        value = F.when(c.cast("string").contains("%"), value / 100).otherwise(value)
    return F.coalesce(value, F.lit(0.0))


def integer(c: Column) -> Column:
    """'1,234' -> 1234, truncated toward zero; unreadable -> 0."""
    value = strict_number(_without(c.cast("string"), ","))
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def first_number(c: Column) -> Column:
    """First digit run in the text with thousands commas dropped, else NULL."""
    run = F.regexp_extract(c.cast("string"), r"(\d[\d,]*\.?\d*)", 1)
    return _without(run, ",").try_cast("double")


def digits_price(c: Column) -> Column:
    """Keep digits and dots only, then read; unreadable -> NULL."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.]", "").try_cast("double")


def bought_count(
    c: Column, on_fail: float | None = 0.0, legacy: bool = False
) -> Column:
    """'2K+ bought in past month' -> 2000.

    By default thousands commas are dropped and only a 'k' right after the
    number multiplies. ``legacy`` keeps the older reading in which any 'k' in
    the text multiplies and '1,000+' is read as 1.
    """
    text = F.lower(c.cast("string"))
    if legacy:
        has_k = text.contains("k")
        k_digits = F.regexp_extract(text, r"([\d.]+)", 1)
    else:
        text = _without(text, ",")
        has_k = text.rlike(r"\d[\d.]*\s*k")
        k_digits = F.regexp_extract(text, r"(\d[\d.]*)\s*k", 1)
    zero, fail = F.lit(0.0), F.lit(on_fail).cast("double")
    in_words = text.contains("+") | text.contains("bought")
    return (
        F.when(text.isNull(), fail)
        .when(has_k, F.coalesce(k_digits.try_cast("double") * 1000, zero))
        .when(
            in_words,
            F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("double"), zero),
        )
        .otherwise(F.coalesce(strict_number(text), fail))
    )


def share_pct(c: Column) -> Column:
    """'80%' -> 80.0; unreadable text -> 0; NULL stays NULL."""
    bare = strip(_without(c.cast("string"), "%"))
    return F.when(c.isNotNull(), F.coalesce(strict_number(bare), F.lit(0.0)))


def share_of(part: Column, total: Column) -> Column:
    """Part of total in percent; 0 when the total is not positive."""
    return F.when(total > 0, F.try_divide(part, total) * 100).otherwise(F.lit(0.0))


def cents(c: Column) -> Column:
    """Money as whole cents, so that sums do not depend on row order."""
    return F.floor(c * 100 + 0.5)


def whole_share(c: Column) -> Column:
    """The integer part of a number as text, as used in tags."""
    return c.cast("bigint").cast("string")
