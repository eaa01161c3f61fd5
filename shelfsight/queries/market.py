"""Queries over the listing table: KPIs, brands, attributes, Pareto, words."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.operators import (
    attributes,
    brand,
    correlation,
    keywords,
    kpi,
    listings,
    pareto,
)
from shelfsight.operators.common import attach, group
from shelfsight.plans.brief import market_brief as brief
from shelfsight.queries import tables
from shelfsight.queries.registry import query
from shelfsight.queries.tables import with_tables

_CENTS = "CAST(floor(monthly_revenue * 100 + 0.5) AS BIGINT)"
_PRICE = "CAST(floor(price * 100 + 0.5) AS BIGINT)"


def _sum(x: str) -> str:
    return f"CAST(COALESCE(SUM({x}), 0) AS BIGINT)"


def _kpis(by: str = "") -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {head}COUNT(*) AS products, AVG(monthly_units) AS avg_units,
  {_sum('monthly_units')} AS total_units, {_sum(_CENTS)} / 100 / COUNT(*) AS avg_revenue,
  {_sum(_CENTS)} / 100 AS total_revenue, {_sum(_PRICE)} / 100 / COUNT(*) AS avg_price,
  round(AVG(growth_rate * 100), 6) AS avg_growth_pct, MAX(monthly_units) AS max_units
FROM listings{tail}"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("market_kpis", with_tables("listings") + _kpis())
def market_kpis(spark, sf_dir):
    return _rounded(kpi.market_kpis(tables.listings(spark, sf_dir)), "avg_growth_pct")


@query("market_kpis_by_category", with_tables("listings") + _kpis("category"))
def market_kpis_by_category(spark, sf_dir):
    df = tables.listings(spark, sf_dir)
    return _rounded(kpi.market_kpis(df, ["category"]), "avg_growth_pct")


@query(
    "top_category",
    with_tables("listings")
    + """SELECT category, COUNT(*) AS products FROM listings GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 1""",
)
def top_category(spark, sf_dir):
    return kpi.top_category(tables.listings(spark, sf_dir))


_BRANDS = f""", brands AS (SELECT brand, {_sum(_CENTS)} AS c FROM listings GROUP BY brand),
shares AS (SELECT brand, c / 100 AS revenue, CAST(SUM(c) OVER () AS BIGINT) / 100
    AS market_revenue,
  (c / 100) / (CAST(SUM(c) OVER () AS BIGINT) / 100) * 100 AS share_pct FROM brands)
"""


@query(
    "brand_revenue_top10",
    with_tables("listings")
    + _BRANDS
    + "SELECT * FROM shares ORDER BY revenue DESC, brand LIMIT 10",
)
def brand_revenue_top10(spark, sf_dir):
    return brand.top_brands(tables.listings(spark, sf_dir))


@query("brand_share", with_tables("listings") + _BRANDS + "SELECT * FROM shares")
def brand_share(spark, sf_dir):
    return brand.brand_revenue(tables.listings(spark, sf_dir))


@query(
    "top5_brands_by_category",
    with_tables("listings")
    + f""", b AS (SELECT category, brand, {_sum(_CENTS)} AS c FROM listings GROUP BY 1, 2),
s AS (SELECT category, brand, c / 100 AS revenue,
    CAST(SUM(c) OVER (PARTITION BY category) AS BIGINT) / 100 AS market_revenue,
    (c / 100) / (CAST(SUM(c) OVER (PARTITION BY category) AS BIGINT) / 100) * 100 AS share_pct,
    row_number() OVER (PARTITION BY category ORDER BY c DESC, brand) AS place FROM b)
SELECT category, brand, revenue, market_revenue, share_pct FROM s WHERE place <= 5""",
)
def top5_brands_by_category(spark, sf_dir):
    return brand.top_brands(tables.listings(spark, sf_dir), 5, ["category"])


def _concentration(by: str = "") -> str:
    head, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    tail = f" GROUP BY {by}" if by else ""
    return f""", b AS (SELECT {head}brand, {_sum(_CENTS)} AS c FROM listings
  GROUP BY {head}brand),
r AS (SELECT *, row_number() OVER ({part}ORDER BY c DESC, brand) AS place FROM b),
cr AS (SELECT {head}{_sum('c')} / 100 AS total_revenue,
  ({_sum('CASE WHEN place <= 5 THEN c END')} / 100) / ({_sum('c')} / 100) * 100 AS cr5,
  ({_sum('CASE WHEN place <= 10 THEN c END')} / 100) / ({_sum('c')} / 100) * 100 AS cr10
  FROM r{tail})
"""


@query(
    "concentration", with_tables("listings") + _concentration() + "SELECT * FROM cr"
)
def concentration(spark, sf_dir):
    return brand.concentration(tables.listings(spark, sf_dir))


@query(
    "concentration_by_category",
    with_tables("listings") + _concentration("category") + "SELECT * FROM cr",
)
def concentration_by_category(spark, sf_dir):
    return brand.concentration(tables.listings(spark, sf_dir), by=["category"])


_BRAND_CHOICE = ("Brand#1", "Brand#7", "Brand#25")


@query(
    "brand_filter",
    with_tables("listings")
    + """SELECT brand, COUNT(*) AS products FROM listings
WHERE brand IN ('Brand#1', 'Brand#7', 'Brand#25') GROUP BY 1""",
)
def brand_filter(spark, sf_dir):
    chosen = kpi.brand_filter(tables.listings(spark, sf_dir), _BRAND_CHOICE)
    return chosen.groupBy("brand").agg(F.count(F.lit(1)).alias("products"))


@query(
    "brand_list",
    with_tables("listings") + "SELECT DISTINCT brand FROM listings ORDER BY brand",
)
def brand_list(spark, sf_dir):
    return kpi.distinct_brands(tables.listings(spark, sf_dir))


# --- attributes --------------------------------------------------------------


def _groups(attr: str, where: str = "TRUE") -> str:
    return f""", named AS (SELECT *, {attr} AS attr FROM listings),
groups AS (SELECT attr, {_sum('monthly_units')} AS units, {_sum(_CENTS)} / 100 AS revenue,
    round(AVG(growth_rate * 100), 6) AS avg_growth_pct,
    {_sum(_PRICE)} / 100 / COUNT(price) AS avg_price, COUNT(asin) AS listings
  FROM named WHERE attr IS NOT NULL AND {where} GROUP BY attr)
"""


_TYPE = "NULLIF(regexp_extract(params_text, 'Type: ([A-Z]+)', 1), '')"
_SIZE = "CAST(NULLIF(regexp_extract(params_text, 'Size:([0-9]+)', 1), '') AS DOUBLE)"
_TITLE = "title"


def _with_params(spark, sf_dir):
    from shelfsight.operators.params import params_wide

    return params_wide(tables.listings(spark, sf_dir), keys=["Color", "Ratio", "Size", "Type"])


@query(
    "attr_text_top15",
    with_tables("listings")
    + _groups(_TITLE)
    + "SELECT * FROM groups ORDER BY revenue DESC, attr LIMIT 15",
)
def attr_text_top15(spark, sf_dir):
    df = tables.listings(spark, sf_dir)
    return _rounded(attributes.top_attributes(df, "title"), "avg_growth_pct")


@query(
    "attr_numeric_top50",
    with_tables("listings")
    + _groups(_SIZE, "attr > 0")
    + "SELECT * FROM (SELECT * FROM groups ORDER BY revenue DESC, attr LIMIT 50) ORDER BY attr",
)
def attr_numeric_top50(spark, sf_dir):
    df = _with_params(spark, sf_dir)
    return _rounded(attributes.top_attributes(df, "参数_Size"), "avg_growth_pct")


@query(
    "attr_days_top50",
    with_tables("listings")
    + _groups("CAST(days_listed AS DOUBLE)", "attr > 0")
    + "SELECT * FROM (SELECT * FROM groups ORDER BY revenue DESC, attr LIMIT 50) ORDER BY attr",
)
def attr_days_top50(spark, sf_dir):
    """More distinct values than the cap, so only the best-selling 50 stay."""
    df = tables.listings(spark, sf_dir)
    return _rounded(attributes.top_attributes(df, "days_listed"), "avg_growth_pct")


@query(
    "attr_price_box",
    with_tables("listings")
    + _groups(_TITLE)
    + f""", leaders AS (SELECT attr FROM groups ORDER BY revenue DESC, attr LIMIT 15),
v AS (SELECT attr, {_PRICE} AS v FROM named WHERE attr IN (SELECT attr FROM leaders))
SELECT attr, round(MIN(v) / 100, 6) AS low, round(quantile_cont(v, 0.25) / 100, 6) AS q1,
  round(quantile_cont(v, 0.5) / 100, 6) AS median,
  round(quantile_cont(v, 0.75) / 100, 6) AS q3, round(MAX(v) / 100, 6) AS high
FROM v GROUP BY attr""",
)
def attr_price_box(spark, sf_dir):
    box = attributes.attribute_price_box(tables.listings(spark, sf_dir), "title")
    return _rounded(box, "low", "q1", "median", "q3", "high")


# A value that is a number in some categories and a text in the others.
_MIXED = """CASE WHEN category < 'P' THEN CAST(days_listed % 97 AS STRING) || CASE WHEN brand < 'Brand#2' THEN '.0' ELSE '' END
  ELSE title END"""
_MIXED_ATTR = """CASE WHEN category < 'P' THEN CASE WHEN days_listed % 97 > 0 THEN CAST(days_listed % 97 AS STRING) END
  ELSE title END"""


def _mixed_leaders() -> str:
    return f""", named AS (SELECT *, {_MIXED_ATTR} AS attr FROM listings),
groups AS (SELECT category, attr, {_sum('monthly_units')} AS units, {_sum(_CENTS)} / 100 AS revenue,
    round(AVG(growth_rate * 100), 6) AS avg_growth_pct,
    {_sum(_PRICE)} / 100 / COUNT(price) AS avg_price, COUNT(asin) AS listings
  FROM named WHERE attr IS NOT NULL GROUP BY category, attr),
placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY revenue DESC,
    CASE WHEN category < 'P' THEN CAST(attr AS DOUBLE) END, attr) AS place FROM groups),
leaders AS (SELECT * EXCLUDE (place) FROM placed
  WHERE place <= CASE WHEN category < 'P' THEN 50 ELSE 15 END)
"""


def _mixed(spark, sf_dir):
    return tables.listings(spark, sf_dir).withColumn("mixed", F.expr(_MIXED))


@query("attr_mixed_kinds_by_category", with_tables("listings") + _mixed_leaders() + "SELECT * FROM leaders")
def attr_mixed_kinds_by_category(spark, sf_dir):
    """Each category decides for itself whether the attribute is a number."""
    top = attributes.top_attributes(_mixed(spark, sf_dir), "mixed", by=["category"])
    return _rounded(top, "avg_growth_pct")


@query(
    "attr_price_box_by_category",
    with_tables("listings")
    + _mixed_leaders()
    + f""", v AS (SELECT category, attr, {_PRICE} AS v FROM named SEMI JOIN leaders USING (category, attr))
SELECT category, attr, round(MIN(v) / 100, 6) AS low, round(quantile_cont(v, 0.25) / 100, 6) AS q1,
  round(quantile_cont(v, 0.5) / 100, 6) AS median,
  round(quantile_cont(v, 0.75) / 100, 6) AS q3, round(MAX(v) / 100, 6) AS high
FROM v GROUP BY category, attr""",
)
def attr_price_box_by_category(spark, sf_dir):
    box = attributes.attribute_price_box(_mixed(spark, sf_dir), "mixed", by=["category"])
    return _rounded(box, "low", "q1", "median", "q3", "high")


@query(
    "top_attr_values",
    with_tables("listings")
    + f""", named AS (SELECT *, {_TYPE} AS attr FROM listings)
SELECT attr, {_sum(_CENTS)} / 100 AS revenue FROM named WHERE attr IS NOT NULL
GROUP BY attr ORDER BY revenue DESC, attr LIMIT 3""",
)
def top_attr_values(spark, sf_dir):
    return attributes.top_attribute_values(_with_params(spark, sf_dir), "参数_Type")


# --- sellers, time, newcomers ------------------------------------------------


@query(
    "hot_listing_months",
    with_tables("listings")
    + """SELECT listed_month, COUNT(*) AS products FROM listings
WHERE monthly_units > (SELECT AVG(monthly_units) FROM listings)
  AND listed_month IS NOT NULL GROUP BY 1""",
)
def hot_listing_months(spark, sf_dir):
    return kpi.hot_listing_months(tables.listings(spark, sf_dir))


def _count_share(column: str) -> str:
    return f"""SELECT {column}, COUNT(*) AS products, COUNT(*)
  / CAST(SUM(COUNT(*)) OVER () AS BIGINT) * 100 AS share_pct FROM listings GROUP BY {column}"""


@query("fulfillment_share", with_tables("listings") + _count_share("fulfillment"))
def fulfillment_share(spark, sf_dir):
    return kpi.count_share(tables.listings(spark, sf_dir), "fulfillment")


@query("buybox_share", with_tables("listings") + _count_share("buybox_type"))
def buybox_share(spark, sf_dir):
    return kpi.count_share(tables.listings(spark, sf_dir), "buybox_type")


@query(
    "newness_revenue",
    with_tables("listings")
    + f"""SELECT newness, COUNT(*) AS products, {_sum(_CENTS)} / 100 AS revenue,
  {_sum(_CENTS)} / 100 / COUNT(*) AS avg_revenue, ({_sum(_CENTS)} / 100)
    / (CAST(SUM(SUM({_CENTS})) OVER () AS BIGINT) / 100) * 100 AS share_pct
FROM listings GROUP BY newness""",
)
def newness_revenue(spark, sf_dir):
    return kpi.newness_revenue(tables.listings(spark, sf_dir))


def _newcomers(by: str = "") -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    new = f"CASE WHEN newness LIKE '%新品%' THEN {_CENTS} END"
    return f"""SELECT {head}COUNT(CASE WHEN newness LIKE '%新品%' THEN 1 END) AS new_products,
  CAST(SUM({new}) AS BIGINT) / 100 / NULLIF(COUNT({new}), 0) AS new_avg_revenue,
  ({_sum(new)} / 100) / ({_sum(_CENTS)} / 100) * 100 AS new_share_pct
FROM listings{tail}"""


@query("new_product_stats", with_tables("listings") + _newcomers())
def new_product_stats(spark, sf_dir):
    return kpi.new_product_stats(tables.listings(spark, sf_dir))


def _quality(by: str = "") -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {head}round(AVG(rating), 6) AS avg_rating, AVG(rating_count) AS avg_reviews,
  COUNT(CASE WHEN rating < 3.8e0 THEN 1 END) / COUNT(*) * 100 AS low_rating_pct
FROM listings{tail}"""


@query("rating_quality", with_tables("listings") + _quality())
def rating_quality(spark, sf_dir):
    return _rounded(kpi.rating_quality(tables.listings(spark, sf_dir)), "avg_rating")


# --- words and correlation ---------------------------------------------------

_STOP = (
    "'the', 'for', 'and', 'with', 'of', 'to', 'in', 'a', 'on', 'at', 'pack', 'pcs', "
    "'set', 'new', 'black', 'white', 'unknown', 'nan', 'generic'"
)
_GAP = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def _words(table: str, column: str, tail: str) -> str:
    bare = (
        f"regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}_"
        f"{_GAP[1:-1]}]', '', 'g')"
    )
    return f"""words AS (SELECT unnest(string_split_regex({bare}, '{_GAP}+')) AS word
  FROM {table})
SELECT word, COUNT(*) AS frequency FROM words
WHERE length(word) > 2 AND word NOT IN ({_STOP})
  AND NOT regexp_full_match(word, '\\p{{Nd}}+')
GROUP BY word {tail}"""


@query(
    "title_keywords",
    with_tables("listings")
    + ", "
    + _words("listings", "title", "ORDER BY frequency DESC, word LIMIT 30"),
)
def title_keywords(spark, sf_dir):
    return keywords.top_keywords(tables.listings(spark, sf_dir))


@query(
    "document_keywords",
    "WITH " + _words("documents", "text", "ORDER BY frequency DESC, word LIMIT 30"),
)
def document_keywords(spark, sf_dir):
    return keywords.top_keywords(tables.read(spark, sf_dir, "documents"), "text")


@query("document_word_counts", "WITH " + _words("documents", "text", ""))
def document_word_counts(spark, sf_dir):
    return keywords.keyword_counts(tables.read(spark, sf_dir, "documents"), "text")


def _correlations() -> str:
    names = correlation.METRICS
    parts = []
    for x in names:
        for y in names:
            r = "1.0" if x == y else f"COALESCE(round(corr({x}, {y}), 6), 0.0)"
            parts.append(
                f"SELECT '{x}' AS x, '{y}' AS y, CAST({r} AS DOUBLE) AS r FROM listings "
                f"HAVING COUNT(DISTINCT {x}) > 1 AND COUNT(DISTINCT {y}) > 1"
            )
    return "\nUNION ALL ".join(parts)


@query("correlation_long", with_tables("listings") + "\n" + _correlations())
def correlation_long(spark, sf_dir):
    return _rounded(correlation.correlation_long(tables.listings(spark, sf_dir)), "r")


# --- Pareto ------------------------------------------------------------------


def _pareto(by: str = "") -> str:
    head, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    tail = f" GROUP BY {by}" if by else ""
    return f""", p AS (SELECT {head}asin, {_CENTS} AS c FROM listings),
run AS (SELECT {head}asin, c,
    CAST(SUM(c) OVER ({part}ORDER BY c DESC, asin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s,
    row_number() OVER ({part}ORDER BY c DESC, asin) AS i, COUNT(*) OVER ({part}) AS n,
    CAST(SUM(c) OVER ({part}) AS BIGINT) AS t FROM p),
curve AS (SELECT {head}asin, c / 100 AS revenue,
    CASE WHEN t > 0 THEN s / t * 100 ELSE 0.0 END AS revenue_pct,
    i / n * 100 AS product_pct FROM run),
head AS (SELECT {head}
    MAX(CASE WHEN i = LEAST(CAST(floor(n * 0.2) AS BIGINT), n - 1) + 1
      THEN CASE WHEN t > 0 THEN s / t * 100 ELSE 0.0 END END) AS top_fifth_revenue_pct,
    COALESCE(MIN(CASE WHEN t > 0 AND s * 100 >= t * 80 THEN i / n * 100 END), 100.0)
      AS products_for_80_pct
  FROM run{tail}),
start AS (SELECT {head}CAST(NULL AS VARCHAR) AS asin, CAST(NULL AS DOUBLE) AS revenue,
    0.0e0 AS revenue_pct, 0.0e0 AS product_pct, COUNT(*) AS k FROM p{tail})
"""


@query(
    "pareto_curve",
    with_tables("listings")
    + _pareto()
    + """SELECT asin, revenue, revenue_pct, product_pct FROM curve
UNION ALL SELECT asin, revenue, revenue_pct, product_pct FROM start""",
)
def pareto_curve(spark, sf_dir):
    return pareto.pareto_curve(tables.listings(spark, sf_dir))


@query(
    "pareto_curve_by_category",
    with_tables("listings")
    + _pareto("category")
    + """SELECT category, asin, revenue, revenue_pct, product_pct FROM curve
UNION ALL SELECT category, asin, revenue, revenue_pct, product_pct FROM start""",
)
def pareto_curve_by_category(spark, sf_dir):
    return pareto.pareto_curve(tables.listings(spark, sf_dir), ["category"])


@query("pareto_headline", with_tables("listings") + _pareto() + "SELECT * FROM head")
def pareto_headline(spark, sf_dir):
    return pareto.pareto_headline(tables.listings(spark, sf_dir))


@query(
    "pareto_headline_by_category",
    with_tables("listings") + _pareto("category") + "SELECT * FROM head",
)
def pareto_headline_by_category(spark, sf_dir):
    return pareto.pareto_headline(tables.listings(spark, sf_dir), ["category"])


# --- listing rows ------------------------------------------------------------


@query(
    "top3_listings",
    with_tables("listings")
    + """SELECT row_number() OVER (ORDER BY monthly_revenue DESC, asin)::INTEGER AS place, asin,
  monthly_revenue, monthly_units, price, substring(title, 1, 50) || '...' AS short_title
FROM listings ORDER BY place LIMIT 3""",
)
def top3_listings(spark, sf_dir):
    return listings.top_listings(tables.listings(spark, sf_dir))


@query(
    "top3_listings_by_category",
    with_tables("listings")
    + """, r AS (SELECT category, row_number() OVER
    (PARTITION BY category ORDER BY monthly_revenue DESC, asin)::INTEGER AS place, asin,
  monthly_revenue, monthly_units, price, substring(title, 1, 50) || '...' AS short_title
  FROM listings)
SELECT * FROM r WHERE place <= 3""",
)
def top3_listings_by_category(spark, sf_dir):
    return listings.top_listings(tables.listings(spark, sf_dir), by=["category"])


@query(
    "growth_leaders",
    with_tables("listings")
    + """SELECT asin, monthly_units, growth_rate * 100 AS growth_pct, price FROM listings
ORDER BY growth_pct DESC NULLS LAST, asin LIMIT 20""",
)
def growth_leaders(spark, sf_dir):
    return listings.growth_leaders(tables.listings(spark, sf_dir))


@query(
    "growth_matrix",
    with_tables("listings")
    + """SELECT asin, title, brand, price, days_listed, monthly_units, monthly_revenue,
  growth_rate * 100 AS growth_pct, GREATEST(monthly_revenue, 100.0e0) AS marker FROM listings""",
)
def growth_matrix(spark, sf_dir):
    return listings.growth_matrix(tables.listings(spark, sf_dir))


@query(
    "growth_reference_lines",
    with_tables("listings")
    + """SELECT AVG(monthly_units) AS avg_units,
  round(AVG(growth_rate * 100), 6) AS avg_growth_pct,
  COUNT(CASE WHEN monthly_units > (SELECT AVG(monthly_units) FROM listings) THEN 1 END)
    AS above_mean FROM listings""",
)
def growth_reference_lines(spark, sf_dir):
    df = tables.listings(spark, sf_dir)
    lines = kpi.market_kpis(df).select("avg_units", "avg_growth_pct")
    above = attach(df, lines.select("avg_units"))
    counted = group(above).agg(
        F.count_if(F.col("monthly_units") > F.col("avg_units")).alias("above_mean")
    )
    return _rounded(attach(lines, counted), "avg_growth_pct")


@query(
    "launch_timeline",
    with_tables("listings")
    + """SELECT asin, brand, CAST(CAST(listed_at AS DATE) AS VARCHAR) AS listed_on,
  monthly_revenue, monthly_units,
  GREATEST(CAST(monthly_units AS DOUBLE), 10.0e0) AS marker FROM listings""",
)
def launch_timeline(spark, sf_dir):
    df = listings.launch_timeline(tables.listings(spark, sf_dir))
    listed_on = F.date_format("listed_at", "yyyy-MM-dd").alias("listed_on")
    return df.select(
        "asin", "brand", listed_on, "monthly_revenue", "monthly_units", "marker"
    )


# --- the brief ---------------------------------------------------------------


def _brief(by: str = "") -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    part = f"PARTITION BY {by} " if by else ""
    match = f"USING ({by})" if by else "ON TRUE"
    from shelfsight.queries.history import _tiers

    return f"""{_concentration(by)}{_tiers(by)}
, totals AS ({_kpis(by)}), quality AS ({_quality(by)}), newcomers AS ({_newcomers(by)}),
bs AS (SELECT *, (c / 100) / (CAST(SUM(c) OVER ({part}) AS BIGINT) / 100) * 100 AS pct FROM r),
top AS (SELECT {head}string_agg(printf('%s(%.1f%%)', brand, pct), ', ' ORDER BY place)
  AS top_brands FROM bs WHERE place <= 5{tail}),
a AS (SELECT {head}title, row_number() OVER ({part}ORDER BY SUM({_CENTS}) DESC, title) AS place
  FROM listings GROUP BY {head}title),
attrs AS (SELECT {head}string_agg(title, ', ' ORDER BY place) AS top_attributes
  FROM a WHERE place <= 3{tail})
SELECT {head}products, total_units, totals.total_revenue, avg_price, cr5, top_brands, avg_rating,
  avg_reviews, low_rating_pct, p25, p75, low_pct, mid_pct, high_pct, new_products,
  new_avg_revenue, new_share_pct, top_attributes
FROM totals JOIN cr {match} JOIN top {match} JOIN quality {match} JOIN tiers {match}
  JOIN newcomers {match} JOIN attrs {match}"""


@query("market_brief", with_tables("listings") + _brief())
def market_brief(spark, sf_dir):
    return _rounded(brief(tables.listings(spark, sf_dir), "title"), "avg_rating")


@query("market_brief_by_category", with_tables("listings") + _brief("category"))
def market_brief_by_category(spark, sf_dir):
    df = tables.listings(spark, sf_dir)
    return _rounded(brief(df, "title", ["category"]), "avg_rating")
