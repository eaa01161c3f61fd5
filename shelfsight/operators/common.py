"""Shared shapes: attach group values, top-n, running totals, quantiles.

Every operator takes ``by``: the columns that name a market. With ``by=()``
the whole input is one market. ``by`` columns must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.functions.numbers import cents, strict_number

# Bins per power of two in ``magnitude_bin``.
BINS_PER_OCTAVE = 256
# Cells into which a bin of real numbers is cut again.
CELLS_PER_BIN = 65_536


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the columns of a per-market result to every row of the market.

    With no ``by`` the one-row result becomes a scalar subquery, so there is no
    join at all. Otherwise it is an equi-join that adaptive execution may turn
    into a broadcast, or split at a hot market, by measured sizes.
    """
    added = [c for c in stats.columns if c not in by]
    if by:
        return df.join(stats, list(by), "left")
    row = stats.select(F.struct(*added).alias("row")).scalar()
    # Named once and then taken apart, so that the subquery is planned once.
    return df.withColumn("_row", row).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.col("_row").getField(c).alias(c) for c in added],
    )


def group(df: DataFrame, by: Sequence[str] = ()):
    """``groupBy`` that also takes no columns."""
    return df.groupBy(*[F.col(c) for c in by])


def is_text(df: DataFrame, name: str) -> bool:
    """Whether the column holds text."""
    return df.schema[name].dataType.typeName() == "string"


def number_in(df: DataFrame, name: str) -> Column:
    """The column as a number: text is read, numbers are taken as they are."""
    column = F.col(f"`{name}`")
    if is_text(df, name):
        return strict_number(column)
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are worked out exactly once per row.

    A filter on a plain computed column moves below the projection and carries
    a copy of the expression with it, and of every expression that one reads.
    For long text parsing that repeats the work and outgrows generated code.
    A filter on the output of a generator stays where it is, so the finished
    values pass through one.
    """
    computed = df.withColumns(columns)
    kept = [F.col(f"`{c}`") for c in computed.columns if c not in columns]
    values = F.struct(*[F.col(f"`{c}`") for c in columns])
    return computed.select(*kept, F.inline(F.array(values)))


def cents_sum(c: Column) -> Column:
    """Sum of cents that no number of rows overflows.

    One row counts for at most 2^63 cents, which no price of a listing reaches.
    """
    return F.sum(cents(c).cast("decimal(20,0)"))


def money_sum(c: Column) -> Column:
    """Exact sum of money; 0 over no rows."""
    return F.coalesce(cents_sum(c).cast("double"), F.lit(0.0)) / 100


def total_money(c: Column) -> Column:
    """Sum of money that is itself a sum, which may pass what one row counts for; 0 over no rows."""
    whole = F.round(c * 100).try_cast("decimal(38,0)")
    return F.coalesce(F.sum(whole).cast("double"), F.lit(0.0)) / 100


def money_avg(c: Column) -> Column:
    """Mean of money from its exact sum; NULL over no rows."""
    return F.try_divide(cents_sum(c).cast("double") / 100, F.count(c))


def rounded_avg(c: Column, digits: int) -> Column:
    """Mean rounded half to even; summed as decimals, so in any row order.

    Holds for values below 10^32; a larger one is no number of any listing and is left out.
    """
    exact = F.avg(c.try_cast("decimal(38,6)"))
    return F.bround(exact, digits).cast("double")


def top_n(
    df: DataFrame, order: Sequence[Column], n: int, by: Sequence[str] = ()
) -> DataFrame:
    """First ``n`` rows, or first ``n`` of each market.

    Both forms keep only n rows per task before the shuffle: a plain limit as
    TakeOrderedAndProject, the per-market one through WindowGroupLimit.
    """
    if not by:
        return df.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def histogram(
    df: DataFrame, value: Column, by: Sequence[str] = (), **measures: Column
) -> DataFrame:
    """One row per distinct non-null value with its count ``n`` and measures.

    Equal values collapse on the map side, so a hot value costs nothing. The
    closing condition always holds; it names every column so that no reader of
    the histogram drops one, and all of them share a single scan and shuffle.
    """
    keyed = df.withColumn("value", value).where(F.col("value").isNotNull())
    counted = group(keyed, [*by, "value"]).agg(
        F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in measures.items()]
    )
    return counted.where(reduce(or_, [F.col(k).isNull() for k in measures], F.col("n") > 0))


def _magnitude(value: Column) -> Column:
    size = F.log2(F.abs(value.cast("double")) + 1) * BINS_PER_OCTAVE
    return F.signum(value) * size


def magnitude_bin(value: Column) -> Column:
    """A bin number that never decreases as the value grows.

    It depends on the value alone, so every task and every retry agrees. There
    are at most 256 bins per power of two, which bounds the bins per market.
    """
    # Never NULL, so that joining on the bin adds no filter to one branch only.
    return F.coalesce(F.floor(_magnitude(value)), F.lit(0))


def magnitude_cell(value: Column) -> Column:
    """A number from 0 to ``CELLS_PER_BIN`` - 1 that never decreases as the value grows inside its bin."""
    part = _magnitude(value) - F.floor(_magnitude(value))
    return F.coalesce(F.floor(part * CELLS_PER_BIN), F.lit(0))


def running_totals(
    hist: DataFrame,
    totals: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    ranks: Sequence[Column] = (),
    split: bool = False,
) -> DataFrame:
    """Add ``before_<c>`` (sum over earlier values) and ``all_<c>`` per total.

    Sums run in two levels. Bins are few, so their running sum is one small
    window per market; values are then summed inside their own bin only. With
    ``ranks`` only the bins that hold one of these row numbers are kept.

    A bin of cents holds no more values than a task can order. One of real
    numbers may hold any number: with ``split`` there is a level between, of at
    most ``CELLS_PER_BIN`` cells in a bin.
    """
    order = F.desc if descending else F.asc

    def holding(rows: DataFrame, first: str, n: str) -> DataFrame:
        if not ranks:
            return rows
        held = [(F.col(first) <= r) & (r < F.col(first) + F.col(n)) for r in ranks]
        return rows.where(reduce(or_, held))

    binned = hist.withColumn("bin", magnitude_bin(F.col("value")))
    market = Window.partitionBy(*[F.col(c) for c in by])
    earlier_bins = market.orderBy(order("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        group(binned, [*by, "bin"])
        .agg(*[F.sum(c).alias(f"bin_{c}") for c in totals])
        .select(
            *by,
            "bin",
            *(["bin_n"] if ranks else []),
            *[
                F.coalesce(F.sum(f"bin_{c}").over(earlier_bins), F.lit(0)).alias(
                    f"bins_before_{c}"
                )
                for c in totals
            ],
            *[F.sum(f"bin_{c}").over(market).alias(f"all_{c}") for c in totals],
        )
    )
    joined = binned.join(holding(bins, "bins_before_n", "bin_n").drop("bin_n"), [*by, "bin"])
    inner = ["bin"]
    if split:
        inner = ["bin", "cell"]
        joined = joined.withColumn("cell", magnitude_cell(F.col("value")))
        earlier_cells = (
            Window.partitionBy(*by, "bin").orderBy(order("cell")).rowsBetween(Window.unboundedPreceding, -1)
        )
        levels = [f"bins_before_{c}" for c in totals] + [f"all_{c}" for c in totals]
        cells = joined.groupBy(*by, *inner, *levels).agg(*[F.sum(c).alias(f"cell_{c}") for c in totals])
        before = {
            f"bins_before_{c}": F.col(f"bins_before_{c}") + F.coalesce(F.sum(f"cell_{c}").over(earlier_cells), F.lit(0))
            for c in totals
        }
        cells = holding(cells.withColumns(before), "bins_before_n", "cell_n").drop(*[f"cell_{c}" for c in totals])
        joined = joined.drop(*levels).join(cells, [*by, *inner])
    inside = (
        Window.partitionBy(*by, *inner)
        .orderBy(order("value"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = {
        f"before_{c}": F.col(f"bins_before_{c}")
        + F.coalesce(F.sum(c).over(inside), F.lit(0))
        for c in totals
    }
    return joined.withColumns(before).drop(
        *inner, *[f"bins_before_{c}" for c in totals]
    )


def _holds(rank: Column) -> Column:
    return (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))


def value_at(rank: Column) -> Column:
    """Aggregate: the value at a 0-based rank of a ``running_totals`` result."""
    return F.max(F.when(_holds(rank), F.col("value")))


def total_at(rank: Column, c: str) -> Column:
    """Aggregate: the sum of a measure over the values up to the one at a 0-based rank."""
    here = F.col(f"before_{c}") + F.coalesce(F.col(c), F.lit(0))
    return F.max(F.when(_holds(rank), here))


def quantiles_of(
    hist: DataFrame,
    probabilities: dict[str, float],
    by: Sequence[str] = (),
    totals: Sequence[str] = (),
    split: bool = False,
) -> DataFrame:
    """Exact quantiles of a histogram, linear between neighbouring ranks.

    Equal to sorting all values and interpolating, but no task ever holds the
    values of a whole market. One row per market; NULLs when it is empty. For
    each measure of ``totals`` there is ``<name>_<measure>``, its sum over the
    values up to the quantile, and ``all_<measure>``. ``split`` is for real
    numbers, as in ``running_totals``.
    """
    ends, exact = [], []
    last = F.col("all_n") - 1
    ranks = [
        rank
        for p in probabilities.values()
        for rank in (F.floor(last * p), F.least(F.floor(last * p) + 1, last))
    ]
    ranked = running_totals(hist, ["n", *totals], by, ranks=ranks, split=split)
    for name, p in probabilities.items():
        rank = F.floor(last * p)
        ends += [
            value_at(rank).alias(f"{name}_lo"),
            value_at(F.least(rank + 1, last)).alias(f"{name}_hi"),
            F.max(last * p - rank).alias(f"{name}_part"),
            # No value lies between the neighbours, so the lower one ends the sum.
            *[total_at(rank, c).alias(f"{name}_{c}") for c in totals],
        ]
        lo, hi = (F.col(f"{name}_{x}").cast("double") for x in ("lo", "hi"))
        exact.append((lo + (hi - lo) * F.col(f"{name}_part")).alias(name))
        exact += [F.col(f"{name}_{c}") for c in totals]
    ends += [F.max(f"all_{c}").alias(f"all_{c}") for c in totals]
    exact += [F.col(f"all_{c}") for c in totals]
    return group(ranked, by).agg(*ends).select(*by, *exact)


def span_below(hist: DataFrame, p: float, by: Sequence[str] = ()) -> DataFrame:
    """Per market of a histogram, the least value, the greatest up to quantile ``p`` and the rows between, both included."""
    rank = F.floor((F.col("all_n") - 1) * p)
    ranked = running_totals(hist, ["n"], by, ranks=[F.lit(0), rank])
    return group(ranked, by).agg(
        value_at(F.lit(0)).alias("least"), value_at(rank).alias("most"), total_at(rank, "n").alias("rows")
    )


def equal_width_bins(
    hist: DataFrame, bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Counts in equal-width bins from minimum to maximum of a histogram."""
    span = group(hist, by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi, value = (F.col(c).cast("double") for c in ("lo", "hi", "value"))
    width = F.try_divide(hi - lo, F.lit(bins))
    place = F.coalesce(
        F.least(
            F.floor(F.try_divide(value - lo, width)),
            F.lit(bins - 1),
        ),
        F.lit(0),
    ).cast("bigint")
    return (
        group(
            attach(hist, span, by).select(
                *by,
                "n",
                place.alias("bin"),
                (F.col("lo") + place * width).alias("bin_lo"),
                (F.col("lo") + (place + 1) * width).alias("bin_hi"),
            ),
            [*by, "bin", "bin_lo", "bin_hi"],
        )
        .agg(F.sum("n").alias("n"))
    )
