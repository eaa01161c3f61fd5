"""The chart tables of a market, from one cleaned listing or history table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.config import APP_SCORE, ScoreConfig, SizeLimits
from shelfsight.functions import numbers
from shelfsight.operators import (
    attributes,
    brand,
    correlation,
    keywords,
    kpi,
    listings,
    pareto,
    parents,
    prices,
    score,
    sizes,
)
from shelfsight.operators.common import with_once
from shelfsight.plans.store import ResultStore
from shelfsight.sources.headers import existing

Charts = dict[str, Callable[[], DataFrame]]


def listing_charts(
    shared: DataFrame, attribute: str | None = None, by: Sequence[str] = ()
) -> Charts:
    """How each listing chart is made; a chart whose column is absent is left out."""
    charts: Charts = {
        "market_kpis": lambda: kpi.market_kpis(shared, by),
        "top_category": lambda: kpi.top_category(shared, by),
        "top_listings": lambda: listings.top_listings(shared, by=by),
        "growth_matrix": lambda: listings.growth_matrix(shared, by),
        "growth_leaders": lambda: listings.growth_leaders(shared, by=by),
        "top_brands": lambda: brand.top_brands(shared, by=by),
        "concentration": lambda: brand.concentration(shared, by=by),
        "keywords": lambda: keywords.top_keywords(shared, by=by),
        "correlation": lambda: correlation.correlation_long(shared, by=by),
        "pareto": lambda: pareto.pareto_curve(shared, by),
        "pareto_headline": lambda: pareto.pareto_headline(shared, by),
    }
    for column in existing(shared, ("fulfillment", "buybox_type")):
        charts[f"{column}_share"] = lambda column=column: kpi.count_share(shared, column, by)
    if existing(shared, ["newness"]):
        charts["newness_revenue"] = lambda: kpi.newness_revenue(shared, by)
    if existing(shared, ["listed_month"]):
        charts["hot_listing_months"] = lambda: kpi.hot_listing_months(shared, by)
        charts["launch_timeline"] = lambda: listings.launch_timeline(shared, by)
    if attribute is not None:
        # Markets beside each other decide in the plan, each for itself.
        def numeric() -> bool | None:
            return None if by else attributes.is_numeric_attribute(shared, attribute)

        charts["attribute"] = lambda: attributes.top_attributes(shared, attribute, numeric(), by)
        charts["attribute_prices"] = lambda: attributes.attribute_price_box(shared, attribute, numeric(), by)
    return charts


def history_charts(
    shared: DataFrame,
    config: ScoreConfig = APP_SCORE,
    limits: SizeLimits = SizeLimits(),
    by: Sequence[str] = (),
) -> Charts:
    """How each chart of a merged or bare history is made; one whose columns are absent is left out.

    ``shared`` holds cleaned history keys and, if merged, the listing columns
    beside them: price efficiency needs ``monthly_revenue``, parents are best told
    from it. Prices are read from the text of the file where it is kept.
    """

    def have(*names: str) -> bool:
        return len(existing(shared, names)) == len(names)

    charts: Charts = {}
    scored = score.opportunity_score(shared, config)
    charts["opportunities"] = lambda: score.top_opportunities(scored, 50, by)
    charts["opportunity_matrix"] = lambda: score.top_opportunities(scored, 100, by).select(
        *by, "asin", "score", "score_price", "score_units", "score_share"
    )
    charts["opportunity_summary"] = lambda: score.opportunity_summary(scored, config, by)
    stats = parents.parent_stats(parents.with_parent(shared), by)
    charts["parents"] = lambda: stats
    charts["parent_kpis"] = lambda: parents.parent_kpis(stats, by)
    charts["variant_histogram"] = lambda: prices.measure_histogram(stats, "variants", by=by)
    if have("oos_90", "rank_curr"):
        charts["out_of_stock"] = lambda: listings.out_of_stock(shared, by)
    raw = next(iter(existing(shared, ("price_curr_raw", "price_curr"))), None)
    if raw is not None:
        if have("monthly_revenue"):
            priced = with_once(shared, {"price_read": numbers.first_number(F.col(raw))})
            bins = prices.price_bins(priced, "price_read", "monthly_revenue", by)
            charts["price_bins"] = lambda: bins
            charts["best_price_bin"] = lambda: prices.best_price_bin(bins, by)
        read = with_once(shared, {"_read": numbers.first_number(F.col(raw))})
        charts["unreadable_prices"] = lambda: kpi.unreadable_sample(read, raw, "_read")
    if have("rank_drops"):
        charts["drops_histogram"] = lambda: prices.measure_histogram(shared, "rank_drops", by=by)
    if have("fbt"):
        charts["fbt_coverage"] = lambda: kpi.coverage(shared, "fbt", by)
    if have(*sizes.SIDES, "sales_text"):
        sized = sizes.sized(shared)
        charts["size_scatter"] = lambda: sized.select(
            *by, *existing(sized, ("asin", "brand", "parent_asin")), *sizes.SIDES, "units", "est_revenue", "longest_side"
        )
        charts["size_bands"] = lambda: sizes.size_bands(sized, by)
        charts["length_bins"] = lambda: sizes.length_bins(sized, by)
        charts["size_compliance"] = lambda: sizes.size_compliance(sized, limits, by)
        charts["size_extent"] = lambda: sizes.size_extent(sized, limits, by)
        charts["size_leaders"] = lambda: sizes.size_leaders(sized, by=by)
    return charts


def listing_dashboard(
    df: DataFrame, attribute: str | None = None, by: Sequence[str] = ()
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Persist the listings and build every listing chart on top of them.

    Returns the persisted table, which the caller unpersists when done, and
    the chart tables by name.
    """
    shared = df.persist(StorageLevel.MEMORY_AND_DISK)
    return shared, {name: make() for name, make in listing_charts(shared, attribute, by).items()}


def history_dashboard(
    df: DataFrame,
    config: ScoreConfig = APP_SCORE,
    limits: SizeLimits = SizeLimits(),
    by: Sequence[str] = (),
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """As ``listing_dashboard``, the charts over price history."""
    shared = df.persist(StorageLevel.MEMORY_AND_DISK)
    return shared, {name: make() for name, make in history_charts(shared, config, limits, by).items()}


def stored_dashboard(
    store: ResultStore,
    load: Callable[[], DataFrame],
    charts: Callable[..., Charts],
    paths: str | Sequence[str],
    name: str = "dashboard",
    **params: Any,
) -> dict[str, DataFrame]:
    """All chart tables out of the store, each made and kept if it is not there.

    ``load`` gives the cleaned table from the files under ``paths``, and
    ``charts`` (``listing_charts`` or ``history_charts``) is called with it and
    ``params``. If every chart is in the store, ``load`` is not called and none
    of the files is opened; if one is missing, the table is persisted once for
    all that are, and released again.
    """
    key = store.key(name, paths, params)
    names = store.find(f"{name}-charts", key)
    found: dict[str, DataFrame | None] = {}
    if names is not None:
        found = {r.chart: store.find(f"{name}-{r.chart}", key) for r in names.collect()}
        if all(f is not None for f in found.values()):
            return found
    shared = load().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        made = charts(shared, **params)
        out = {}
        for chart, make in made.items():
            kept = found.get(chart)
            out[chart] = store.keep(f"{name}-{chart}", key, make()) if kept is None else kept
        listed = store.spark.createDataFrame([(c,) for c in made], "chart string")
        store.keep(f"{name}-charts", key, listed)
        return out
    finally:
        shared.unpersist()
