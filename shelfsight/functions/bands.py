"""Right-closed bands, equal-width bins and their labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfsight.config import (
    PRICE_BAND_EDGES,
    SIZE_BAND_EDGES,
    SIZE_BAND_LABELS,
)


def cut(
    value: Column, edges: Sequence[float | None], labels: Sequence[str]
) -> Column:
    """Label of the band (lo, hi] holding the value; NULL outside all bands."""
    band = F.when(value <= edges[0], F.lit(None))
    for hi, label in zip(edges[1:], labels, strict=True):
        inside = value.isNotNull() if hi is None else value <= hi
        band = band.when(inside, F.lit(label))
    return band


def band_labels(edges: Sequence[float | None]) -> list[str]:
    """'lo-hi' for closed bands and 'lo+' for an open last one."""
    return [
        f"{lo}+" if hi is None else f"{lo}-{hi}"
        for lo, hi in zip(edges, edges[1:], strict=False)
    ]


def price_band(price: Column) -> Column:
    """Price band label; 'nan' for a missing or non-positive price."""
    labels = band_labels(PRICE_BAND_EDGES)
    return F.coalesce(cut(price, PRICE_BAND_EDGES, labels), F.lit("nan"))


def size_band(longest_side: Column) -> Column:
    """Size band of the longest side; NULL when outside (0, 999] cm."""
    return cut(longest_side, SIZE_BAND_EDGES, SIZE_BAND_LABELS)


def step_bin(value: Column, step: int) -> Column:
    """Lower edge of the ``step``-wide bin holding the value."""
    return (F.floor(value / step) * step).cast("bigint")


def range_label(lo: Column, hi: Column) -> Column:
    """'$10-$20' for bins at least 5 wide, else '$1.5-$2.0'."""
    whole = F.concat(
        F.lit("$"), lo.cast("bigint").cast("string"),
        F.lit("-$"), hi.cast("bigint").cast("string"),
    )
    tenths = F.format_string("$%.1f-$%.1f", F.bround(lo, 1), F.bround(hi, 1))
    return F.when(hi - lo >= 5, whole).otherwise(tenths)
