"""Running revenue share of products ordered by revenue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.functions.numbers import cents, share_of
from shelfsight.operators.common import group, histogram, running_totals

# Copies of one row are numbered in arrays of at most this length.
COPIES_PER_ARRAY = 65_536
# Products of equal revenue that are put in order in one task.
TIES_PER_GROUP = 65_536
# Sums of cents are decimals: no number of rows overflows them.
CENTS, SUM = "decimal(20,0)", "decimal(38,0)"
LOWEST = -(2**63)


def _letters(ties_per_group: int) -> Column:
    """How many letters of ``tie`` cut a group of ``ties`` between ``least`` and ``most`` into small ones.

    Those that all share, one more for each factor of ten in their number, and
    one for ids that crowd on some letters.
    """
    upto = F.sequence(F.lit(1), F.greatest(F.length("least"), F.lit(1)))
    shared = F.filter(upto, lambda i: F.substring("least", F.lit(1), i) == F.substring("most", F.lit(1), i))
    return (F.size(shared) + F.ceil(F.log10(F.col("ties") / ties_per_group)) + 1).cast("int")


def _part(ties_per_group: int) -> Column:
    """The first letters of ``tie`` that tell groups of ties apart; none where there are few."""
    cut = F.substring("tie", F.lit(1), F.col("letters"))
    return F.when(F.col("ties") > ties_per_group, cut).otherwise(F.lit(""))


def pareto_curve(
    df: DataFrame, by: Sequence[str] = (), ties_per_group: int = TIES_PER_GROUP
) -> DataFrame:
    """Every product with its cumulative revenue and product share in percent.

    Products are ordered by revenue, then id; each market starts with an
    origin row (0, 0). A market may be larger than a task: the histogram of its
    revenues tells what lies before each of them, so only products of equal
    revenue are put in order. More than ``ties_per_group`` of those are split by
    the first letters of their ids, as many as their range and number call for.
    All of it follows from the rows alone, so every task and every retry agrees,
    and nothing is run or kept while the plan is made.

    A product without revenue comes last and has no share of it.
    """
    earned = cents(F.col("monthly_revenue"))
    copies = df.groupBy(*by, "asin", earned.alias("revenue_cents")).agg(F.count(F.lit(1)).alias("copies"))
    copies = copies.withColumns(
        {
            "value": F.coalesce(F.greatest("revenue_cents", F.lit(LOWEST + 1)), F.lit(LOWEST)),
            # A missing id comes before all others, an empty one too.
            "tie": F.coalesce(F.concat(F.lit(" "), F.col("asin").cast("string")), F.lit("")),
        }
    )
    hist = copies.groupBy(*by, "value").agg(
        F.sum("copies").alias("n"),
        F.sum(F.col("revenue_cents").cast(CENTS) * F.col("copies").cast(CENTS)).alias("cents"),
        F.count(F.lit(1)).alias("ties"),
        F.min("tie").alias("least"),
        F.max("tie").alias("most"),
    )
    hist = hist.withColumn("letters", _letters(ties_per_group)).drop("least", "most")
    # The closing condition keeps all columns, so that all readers share one shuffle.
    hist = hist.where((F.col("n") > 0) | F.col("letters").isNull() | F.col("cents").isNull())
    keys = [*by, "value"]
    part = _part(ties_per_group)
    # Mostly empty, and then neither made nor joined.
    many = copies.join(hist.where(F.col("ties") > ties_per_group).select(*keys, "ties", "letters"), keys)
    held = many.groupBy(*keys, part.alias("part")).agg(F.sum("copies").alias("held"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*keys, "part", F.sum("held").over(earlier).alias("held_before"))

    ranked = running_totals(hist, ["n", "cents"], by, descending=True)
    placed = copies.join(ranked, keys).withColumn("part", part).join(held, [*keys, "part"], "left")
    inside = Window.partitionBy(*keys, "part").orderBy("tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce("held_before", F.lit(0)) + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    summed = placed.withColumn("before_ties", before)

    copy = F.col("copy")
    cents_before = F.col("before_cents") + F.col("before_ties").cast(CENTS) * F.col("revenue_cents").cast(CENTS)
    blocks = F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES_PER_ARRAY))
    in_block = F.sequence(
        F.col("block") * COPIES_PER_ARRAY + 1,
        F.least((F.col("block") + 1) * COPIES_PER_ARRAY, F.col("copies")),
    )
    sums = summed.select(
        *by,
        "asin",
        "revenue_cents",
        "copies",
        cents_before.alias("cents_before"),
        (F.col("before_n") + F.col("before_ties")).alias("rows_before"),
        F.col("all_cents").cast("double").alias("all_cents"),
        F.col("all_n").alias("all_rows"),
    )
    curve = (
        sums.withColumn("block", F.explode(blocks))
        # The blocks of one row go to several tasks, which write out its copies.
        .repartition(*[F.col(c) for c in by], "asin", "revenue_cents", "block")
        .withColumn("copy", F.explode(in_block))
        .select(
            *by,
            "asin",
            (F.col("revenue_cents") / 100).alias("revenue"),
            share_of(
                (F.col("cents_before") + copy.cast(CENTS) * F.col("revenue_cents").cast(CENTS)).cast("double"),
                F.col("all_cents"),
            ).alias("revenue_pct"),
            share_of(F.col("rows_before") + copy, F.col("all_rows")).alias("product_pct"),
        )
    )
    origin = group(hist, by).agg(
        F.lit(0.0).alias("revenue_pct"), F.lit(0.0).alias("product_pct")
    )
    return curve.unionByName(origin, allowMissingColumns=True)


def pareto_headline(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue share of the top fifth and product share behind 80 % of revenue.

    Both need only the distinct revenues and their counts, so no product is
    ever sorted. The top fifth is the first int(0.2 n) + 1 products.
    """
    revenues = histogram(df, cents(F.col("monthly_revenue")), by).withColumn(
        "cents", F.col("value").cast(CENTS) * F.col("n").cast(CENTS)
    )
    ranked = running_totals(revenues, ["n", "cents"], by, descending=True)
    value, before = F.col("value").cast(CENTS), F.col("before_cents").cast(SUM)
    total, rows = F.col("all_cents").cast(SUM), F.col("all_n")
    fifth = F.least(F.floor(rows * 0.2), rows - 1)
    holds_fifth = (F.col("before_n") <= fifth) & (fifth < F.col("before_n") + F.col("n"))
    at_fifth = before + value * (fifth - F.col("before_n") + 1).cast(CENTS)
    # Products of this value still needed to reach four fifths of the revenue.
    ranked = ranked.withColumns(
        {"_missing": (total * 80 - before * 100).cast(SUM), "_each": (value * 100).cast(SUM)}
    )
    missing, each = F.col("_missing"), F.col("_each")
    enough = (total > 0) & (value > 0) & (missing <= each * F.col("n").cast(CENTS))
    needed = F.expr("(_missing + _each - 1) div _each")
    reached = F.when(enough, F.col("before_n") + F.greatest(needed, F.lit(1))).when(
        (total > 0) & (missing <= 0), F.col("before_n") + 1
    )
    return group(ranked, by).agg(
        F.max(F.when(holds_fifth, share_of(at_fifth.cast("double"), total.cast("double")))).alias(
            "top_fifth_revenue_pct"
        ),
        F.coalesce(
            F.min(share_of(reached, rows)).cast("double"), F.lit(100.0)
        ).alias("products_for_80_pct"),
    )
