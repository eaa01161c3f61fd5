"""Queries over price history: score, parents, prices, sizes, stock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.config import APP_SCORE, ScoreConfig
from shelfsight.functions import numbers
from shelfsight.operators import clean, kpi, listings, parents, prices, score, sizes
from shelfsight.operators.common import histogram, quantiles_of, with_once
from shelfsight.plans.dashboard import history_charts, stored_dashboard
from shelfsight.plans.store import ResultStore
from shelfsight.queries import tables
from shelfsight.queries.cleaning import _bare, _num
from shelfsight.queries.registry import TWINS, query, sql_round
from shelfsight.queries.tables import with_tables
from shelfsight.session import ensure_checkpoint_dir

# --- opportunity score -------------------------------------------------------


def scored_history(spark, sf_dir, config: ScoreConfig = APP_SCORE):
    history = clean.clean_history(tables.history_export(spark, sf_dir))
    history = history.withColumn("asin", numbers.strip(F.col("asin")))
    return score.opportunity_score(history, config)


def _scored(c: ScoreConfig) -> str:
    """Twin of the score, written as SQL steps over the history export."""
    return f""", hist AS (
  SELECT trim("ASIN") AS asin, "Brand" AS brand, lower("Bought in past month") AS s,
    COALESCE({_num(_bare('"Sales Rank: Drops last 90 days"'))}, 0.0) AS drops,
    COALESCE({_num("replace(" + _bare('"Buy Box 🚚: Current"') + ", '$', '')")}, 0.0) AS price,
    COALESCE({_num(_bare('"Reviews: Rating Count"'))}, 9999.0) AS reviews,
    COALESCE({_num(_bare('"Reviews: Rating"'))}, 0.0) AS rating,
    COALESCE({_num(_bare('"Buy Box 🚚: 90 days OOS"'))}, 0.0) AS oos,
    {_num(_bare('"Buy Box: % Amazon 90 days"'))} AS share,
    CAST("Count of retrieved live offers: New, FBA" AS DOUBLE)
      + CAST("Count of retrieved live offers: New, FBM" AS DOUBLE) AS offers
  FROM history),
steps AS (
  SELECT *, CASE WHEN s IS NULL THEN 0.0
      WHEN s LIKE '%k%' THEN CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE) * 1000
      WHEN s LIKE '%+%' THEN CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE)
      ELSE CAST(s AS DOUBLE) END AS sales,
    price >= {c.price_min} AND price <= {c.price_max} AS fits FROM hist),
parts AS (
  SELECT *,
    CASE WHEN sales > 0 THEN LEAST(100.0, sales / {c.target_sales}.0e0 * 100)
      WHEN drops > 0 THEN LEAST(100.0, drops / 30 * 80) ELSE 0.0 END AS a,
    CASE WHEN fits THEN 100.0 WHEN price > 0 THEN GREATEST(0.0, 100 - 3 *
      LEAST(abs(price - {c.price_min}), abs(price - {c.price_max}))) ELSE 0.0 END AS b,
    CASE WHEN reviews < {c.max_reviews}
      THEN 100 - reviews / {c.max_reviews}.0e0 * 50 ELSE 0.0 END
      * CASE WHEN share > 80 THEN 0.1e0 WHEN share > 50 THEN 0.5e0 ELSE 1e0 END AS c,
    (sales > {c.target_sales} * 0.5 OR drops > 45) AND rating >= 3.0 AND rating <= 3.9
      AS improvable FROM steps),
summed AS (
  SELECT *, (a * {c.w_sales} + b * {c.w_profit} + c * {c.w_comp} + (
    CASE WHEN oos > 15 THEN 40.0e0 ELSE 0 END + CASE WHEN improvable THEN 60.0e0 ELSE 0 END)
    * {c.w_growth}) / {c.total_weight}.0e0 AS total FROM parts),
scored AS (
  SELECT asin, brand, CAST(trunc(total) AS INTEGER) AS score,
    array_to_string(list_filter([
      CASE WHEN sales > 1000 THEN '🔥月销1k+' END,
      CASE WHEN sales <= 0 AND drops > 60 THEN '📉高频出单' END,
      CASE WHEN NOT fits AND price > 0 AND price < 10 THEN '⚠️低价' END,
      CASE WHEN reviews < {c.max_reviews} AND reviews < 50 THEN '✨新星' END,
      CASE WHEN share > 50 THEN '🦖AMZ垄断' END,
      CASE WHEN offers > 0 AND offers < 5 THEN '👥卖家少' END,
      CASE WHEN oos > 15 THEN '🚨缺货' || CAST(CAST(trunc(oos) AS BIGINT) AS VARCHAR) || '%' END,
      CASE WHEN improvable THEN '🛠️改良机会' END], lambda x: x IS NOT NULL)[1:3], ' ') AS tags,
    CASE WHEN sales > 0 THEN CAST(trunc(sales) AS BIGINT) ELSE 0 END AS score_units,
    price AS score_price, rating AS score_rating, share AS score_share
  FROM summed)
"""


_SCORE_COLUMNS = (
    "asin", "brand", "score", "tags",
    "score_units", "score_price", "score_rating", "score_share",
)


@query(
    "opportunity_score",
    with_tables("history")
    + _scored(APP_SCORE)
    + f"SELECT {', '.join(_SCORE_COLUMNS)} FROM scored WHERE score > 0",
)
def opportunity_score(spark, sf_dir):
    scored = scored_history(spark, sf_dir)
    return score.opportunities(scored).select(*_SCORE_COLUMNS)


@query(
    "opportunity_score_defaults",
    with_tables("history")
    + _scored(ScoreConfig())
    + f"SELECT {', '.join(_SCORE_COLUMNS)} FROM scored",
)
def opportunity_score_defaults(spark, sf_dir):
    return scored_history(spark, sf_dir, ScoreConfig()).select(*_SCORE_COLUMNS)


@query(
    "opportunity_top50",
    with_tables("history")
    + _scored(APP_SCORE)
    + f"""SELECT {', '.join(_SCORE_COLUMNS)} FROM scored WHERE score > 0
ORDER BY score DESC, asin LIMIT 50""",
)
def opportunity_top50(spark, sf_dir):
    return score.top_opportunities(scored_history(spark, sf_dir)).select(*_SCORE_COLUMNS)


@query(
    "opportunity_top100_chart",
    with_tables("history")
    + _scored(APP_SCORE)
    + """SELECT asin, score, score_price, score_units, score_share FROM scored
WHERE score > 0 ORDER BY score DESC, asin LIMIT 100""",
)
def opportunity_top100_chart(spark, sf_dir):
    return score.top_opportunities(scored_history(spark, sf_dir), 100).select(
        "asin", "score", "score_price", "score_units", "score_share"
    )


@query(
    "opportunity_summary",
    with_tables("history")
    + _scored(APP_SCORE)
    + """SELECT COUNT(*) AS analysed, COUNT(CASE WHEN score > 0 THEN 1 END) AS kept,
  CAST(35 AS INTEGER) AS w_sales_pct, CAST(20 AS INTEGER) AS w_profit_pct,
  CAST(25 AS INTEGER) AS w_comp_pct, CAST(20 AS INTEGER) AS w_growth_pct FROM scored""",
)
def opportunity_summary(spark, sf_dir):
    return score.opportunity_summary(scored_history(spark, sf_dir), APP_SCORE)


# --- parents and variants ----------------------------------------------------

_STATS = f"""COUNT(asin) AS variants, CAST(SUM(monthly_units) AS BIGINT) AS units,
  MIN(category_rank) AS best_rank, {sql_round('AVG(rating)', 2)} AS avg_rating,
  CAST(SUM(rating_count) AS BIGINT) AS reviews, {sql_round('AVG(oos_90)', 2)} AS avg_oos"""

_EXPLICIT = """CASE WHEN CAST(substr(asin, 2) AS BIGINT) % 3 = 0 THEN '独立产品'
  ELSE 'P' || lpad(CAST(CAST(substr(asin, 2) AS BIGINT)
    - CAST(substr(asin, 2) AS BIGINT) % 10 AS VARCHAR), 12, '0') END"""

_CORE = """array_to_string(list_filter(string_split_regex(lower(title), '\\s+'),
  lambda w: length(w) > 2 AND w NOT IN
    ('pack', 'set', 'size', 'color', 'with', 'for', 'the', 'and', 'new'))[1:5], ' ')"""

_BAND = """CASE WHEN price <= 0 OR price IS NULL THEN 'nan' WHEN price <= 10 THEN '0-10'
  WHEN price <= 25 THEN '10-25' WHEN price <= 50 THEN '25-50'
  WHEN price <= 100 THEN '50-100' WHEN price <= 1000 THEN '100-1000' ELSE '1000+' END"""


def _with_explicit_parent(spark, sf_dir):
    number = F.substring("asin", 2, 12).cast("bigint")
    parent = F.concat(
        F.lit("P"), F.lpad((number - number % 10).cast("string"), 12, "0")
    )
    df = tables.listings(spark, sf_dir)
    return df.withColumn("parent_asin", F.when(number % 3 != 0, parent))


@query(
    "parent_explicit",
    with_tables("listings")
    + f"SELECT {_EXPLICIT} AS parent_id, {_STATS} FROM listings GROUP BY 1",
)
def parent_explicit(spark, sf_dir):
    df = parents.with_parent(_with_explicit_parent(spark, sf_dir))
    return parents.parent_stats(df)


_SYNTHETIC = f"brand || ' | ' || {_CORE} || ' | ' || {_BAND}"


@query(
    "parent_synthetic",
    with_tables("listings")
    + f"SELECT {_SYNTHETIC} AS parent_id, {_STATS} FROM listings GROUP BY 1",
)
def parent_synthetic(spark, sf_dir):
    return parents.parent_stats(parents.with_parent(tables.listings(spark, sf_dir)))


@query(
    "parent_kpis",
    with_tables("listings")
    + f""", stats AS (SELECT {_SYNTHETIC} AS parent_id, COUNT(asin) AS variants
  FROM listings GROUP BY 1)
SELECT COUNT(*) AS parents, COUNT(CASE WHEN variants = 1 THEN 1 END) AS single_variant,
  AVG(variants) AS avg_variants FROM stats""",
)
def parent_kpis(spark, sf_dir):
    df = parents.with_parent(tables.listings(spark, sf_dir))
    return parents.parent_kpis(parents.parent_stats(df))


def _bins(source: str, column: str) -> str:
    return f""", span AS (SELECT MIN({column}) AS lo, MAX({column}) AS hi,
    (CAST(MAX({column}) AS DOUBLE) - MIN({column})) / 20 AS width FROM {source}),
placed AS (SELECT lo, width, COALESCE(CAST(LEAST(floor(({column} - lo) / NULLIF(width, 0)), 19)
  AS BIGINT), 0) AS bin FROM {source}, span WHERE {column} IS NOT NULL)
SELECT bin, lo + bin * width AS bin_lo, lo + (bin + 1) * width AS bin_hi, COUNT(*) AS n
FROM placed GROUP BY bin, lo, width"""


@query(
    "variant_histogram",
    with_tables("listings")
    + f""", stats AS (SELECT {_SYNTHETIC} AS parent_id, COUNT(asin) AS variants
  FROM listings GROUP BY 1)"""
    + _bins("stats", "variants"),
)
def variant_histogram(spark, sf_dir):
    df = parents.with_parent(tables.listings(spark, sf_dir))
    return prices.measure_histogram(parents.parent_stats(df), "variants")


@query("drops_histogram", with_tables("listings") + _bins("listings", "rank_drops"))
def drops_histogram(spark, sf_dir):
    return prices.measure_histogram(tables.listings(spark, sf_dir), "rank_drops")


# --- prices ------------------------------------------------------------------

def _price_bins_sql(price: str = "price") -> str:
    return _PRICE_BINS.replace("FROM (SELECT asin, monthly_revenue,", f"FROM (SELECT asin, monthly_revenue, {price} AS price FROM (SELECT asin, monthly_revenue,").replace(
        "FROM listings)\n  WHERE", "FROM listings))\n  WHERE"
    )


_PRICE_BINS = """, priced AS (
  SELECT asin, CAST(floor(price * 100 + 0.5) AS BIGINT) AS v,
    CAST(floor(monthly_revenue * 100 + 0.5) AS BIGINT) AS r
  FROM (SELECT asin, monthly_revenue, TRY_CAST(replace(NULLIF(regexp_extract(price_curr_raw,
    '([0-9][0-9,]*\\.?[0-9]*)', 1), ''), ',', '') AS DOUBLE) AS price FROM listings)
  WHERE price > 0 AND monthly_revenue > 0),
usual AS (SELECT * FROM priced WHERE v <= (SELECT quantile_cont(v, 0.99) FROM priced)),
span AS (SELECT CAST(floor(MIN(v) / 100) AS BIGINT) AS lo, CAST(ceil(MAX(v) / 100) AS BIGINT)
    AS hi, COUNT(*) AS n FROM usual),
edges AS (SELECT lo, CASE WHEN hi = lo THEN 10 ELSE hi - lo END AS width FROM span WHERE n > 1),
placed AS (SELECT *, GREATEST(((v - lo * 100) * 10 + width * 100 - 1) // (width * 100), 1)
    AS bin FROM usual, edges),
bins AS (SELECT bin, lo + (bin - 1) * width / 10 AS bin_lo, lo + bin * width / 10 AS bin_hi,
    CAST(SUM(r) AS BIGINT) / 100 / COUNT(*) AS avg_revenue, COUNT(asin) AS listings
  FROM placed GROUP BY bin, lo, width),
labelled AS (SELECT *, CASE WHEN bin_hi - bin_lo >= 5 THEN
    '$' || CAST(CAST(trunc(bin_lo) AS BIGINT) AS VARCHAR) || '-$'
      || CAST(CAST(trunc(bin_hi) AS BIGINT) AS VARCHAR)
    ELSE printf('$%.1f-$%.1f', bin_lo, bin_hi) END AS price_range FROM bins)
"""


def _bins_of_listings(spark, sf_dir):
    price = numbers.first_number(F.col("price_curr_raw"))
    df = with_once(tables.listings(spark, sf_dir), {"price_read": price})
    return prices.price_bins(df, "price_read", "monthly_revenue")


@query("price_bins", with_tables("listings") + _PRICE_BINS + "SELECT * FROM labelled")
def price_bins(spark, sf_dir):
    return _bins_of_listings(spark, sf_dir)


@query(
    "best_price_bin",
    with_tables("listings")
    + _PRICE_BINS
    + "SELECT * FROM labelled ORDER BY avg_revenue DESC, bin LIMIT 1",
)
def best_price_bin(spark, sf_dir):
    return prices.best_price_bin(_bins_of_listings(spark, sf_dir))


@query(
    "price_bins_narrow",
    with_tables("listings") + _price_bins_sql("price * 0.01e0") + "SELECT * FROM labelled",
)
def price_bins_narrow(spark, sf_dir):
    """Prices in hundreds, so that bins are less than 5 wide and labelled in tenths."""
    price = numbers.first_number(F.col("price_curr_raw")) * 0.01
    df = with_once(tables.listings(spark, sf_dir), {"price_read": price})
    return prices.price_bins(df, "price_read", "monthly_revenue")


def _tiers(by: str = "") -> str:
    head, group, match = (
        (f"{by}, ", f"GROUP BY {by}", f"USING ({by})") if by else ("", "", "ON TRUE")
    )
    return f""", v AS (SELECT {head}CAST(floor(price * 100 + 0.5) AS BIGINT) AS v,
    monthly_units AS u FROM listings),
q AS (SELECT {head}quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75
  FROM v {group}),
t AS (SELECT * FROM v JOIN q {match}),
tiers AS (SELECT {head}MAX(p25) / 100 AS p25, MAX(p75) / 100 AS p75,
  CAST(COALESCE(SUM(CASE WHEN v <= p25 THEN u END), 0) AS BIGINT)
    / CAST(SUM(u) AS BIGINT) * 100 AS low_pct,
  CAST(COALESCE(SUM(CASE WHEN v > p25 AND v <= p75 THEN u END), 0) AS BIGINT)
    / CAST(SUM(u) AS BIGINT) * 100 AS mid_pct,
  CAST(COALESCE(SUM(CASE WHEN v > p75 THEN u END), 0) AS BIGINT)
    / CAST(SUM(u) AS BIGINT) * 100 AS high_pct
  FROM t {group})
"""


@query("price_tiers", with_tables("listings") + _tiers() + "SELECT * FROM tiers")
def price_tiers(spark, sf_dir):
    return prices.price_tiers(tables.listings(spark, sf_dir))


@query(
    "price_tiers_by_category",
    with_tables("listings") + _tiers("category") + "SELECT * FROM tiers",
)
def price_tiers_by_category(spark, sf_dir):
    return prices.price_tiers(tables.listings(spark, sf_dir), ["category"])


@query(
    "line_price_quartiles",
    """WITH v AS (SELECT l_returnflag,
  CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS v FROM lineitem)
SELECT l_returnflag, round(quantile_cont(v, 0.25), 4) AS q1,
  round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3,
  round(quantile_cont(v, 0.99), 4) AS p99
FROM v GROUP BY l_returnflag""",
)
def line_price_quartiles(spark, sf_dir):
    """Exact quantiles over every order line."""
    lines = tables.read(spark, sf_dir, "lineitem")
    hist = histogram(
        lines, numbers.cents(F.col("l_extendedprice")), ["l_returnflag"]
    )
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}
    exact = quantiles_of(hist, wanted, ["l_returnflag"])
    return exact.select(
        "l_returnflag", *[F.round(name, 4).alias(name) for name in wanted]
    )


@query(
    "fbt_coverage",
    with_tables("listings")
    + """SELECT COUNT(fbt) AS filled, COUNT(*) AS products,
  COUNT(fbt) / COUNT(*) * 100 AS coverage_pct FROM listings""",
)
def fbt_coverage(spark, sf_dir):
    return kpi.coverage(tables.listings(spark, sf_dir), "fbt")


# --- parcel sizes ------------------------------------------------------------

_SIZED = """, raw AS (SELECT asin, title, brand, pkg_l, pkg_w, pkg_h, lower(sales_text) AS s,
    TRY_CAST(NULLIF(regexp_replace(price_curr_raw, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS p
  FROM listings),
counted AS (SELECT *, CASE
    WHEN s LIKE '%k%' THEN CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE) * 1000
    WHEN s LIKE '%+%' THEN CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE)
    ELSE CAST(s AS DOUBLE) END AS units FROM raw),
sized AS (SELECT *, units * p AS est_revenue, GREATEST(pkg_l, pkg_w, pkg_h) AS side
  FROM counted WHERE pkg_l IS NOT NULL AND pkg_w IS NOT NULL AND pkg_h IS NOT NULL
    AND units IS NOT NULL)
"""


def _sized(spark, sf_dir):
    return sizes.sized(tables.listings(spark, sf_dir))


@query(
    "size_bands",
    with_tables("listings")
    + _SIZED
    + """, banded AS (SELECT *, CASE WHEN side <= 0 OR side > 999 THEN NULL
    WHEN side <= 10 THEN '0-10cm' WHEN side <= 20 THEN '10-20cm' WHEN side <= 30 THEN '20-30cm'
    WHEN side <= 45 THEN '30-45cm' WHEN side <= 60 THEN '45-60cm'
    WHEN side <= 100 THEN '60-100cm' ELSE '100cm+' END AS size_band FROM sized),
bands AS (SELECT size_band, COUNT(asin) AS listings, AVG(units) AS avg_units,
    CAST(COALESCE(SUM(CAST(floor(est_revenue * 100 + 0.5) AS BIGINT)), 0) AS BIGINT) AS c
  FROM banded WHERE size_band IS NOT NULL GROUP BY 1)
SELECT size_band, listings, avg_units, c / 100 AS revenue,
  CASE WHEN CAST(SUM(c) OVER () AS BIGINT) > 0 THEN
    (c / 100) / (CAST(SUM(c) OVER () AS BIGINT) / 100) * 100 ELSE 0.0 END AS share_pct
FROM bands""",
)
def size_bands(spark, sf_dir):
    return sizes.size_bands(_sized(spark, sf_dir))


@query(
    "length_bins",
    with_tables("listings")
    + _SIZED
    + """, b AS (SELECT CAST(floor(pkg_l / 5) * 5 AS BIGINT) AS length_bin, units FROM sized)
SELECT length_bin, SUM(units) AS units, CAST(length_bin AS VARCHAR) || '-'
  || CAST(length_bin + 5 AS VARCHAR) || 'cm' AS label FROM b GROUP BY length_bin""",
)
def length_bins(spark, sf_dir):
    return sizes.length_bins(_sized(spark, sf_dir))


@query(
    "size_compliance",
    with_tables("listings")
    + _SIZED
    + """SELECT COUNT(*) AS products, COUNT(CASE WHEN pkg_l > 91.44 THEN 1 END) AS over_length,
  COUNT(CASE WHEN pkg_w > 63.5 THEN 1 END) AS over_width,
  COUNT(CASE WHEN pkg_h > 63.5 THEN 1 END) AS over_height,
  COUNT(CASE WHEN pkg_l > 91.44 THEN 1 END) / COUNT(*) * 100 AS over_length_pct,
  COUNT(CASE WHEN pkg_w > 63.5 THEN 1 END) / COUNT(*) * 100 AS over_width_pct,
  COUNT(CASE WHEN pkg_h > 63.5 THEN 1 END) / COUNT(*) * 100 AS over_height_pct FROM sized""",
)
def size_compliance(spark, sf_dir):
    return sizes.size_compliance(_sized(spark, sf_dir))


@query(
    "size_extent",
    with_tables("listings")
    + _SIZED
    + """SELECT round(GREATEST(quantile_cont(pkg_l, 0.99) * 1.1e0, 91.44e0 * 1.05e0), 6)
    AS max_length,
  round(GREATEST(quantile_cont(pkg_w, 0.99) * 1.1e0, 63.5e0 * 1.05e0), 6) AS max_width
FROM sized""",
)
def size_extent(spark, sf_dir):
    extent = sizes.size_extent(_sized(spark, sf_dir))
    return extent.select(*[F.round(c, 6).alias(c) for c in extent.columns])


@query(
    "size_leaders",
    with_tables("listings")
    + _SIZED
    + """SELECT asin, title, brand, units, est_revenue, pkg_l, pkg_w, pkg_h FROM sized
ORDER BY units DESC, asin LIMIT 10""",
)
def size_leaders(spark, sf_dir):
    return sizes.size_leaders(_sized(spark, sf_dir))


@query(
    "size_leader_bound",
    with_tables("listings")
    + _SIZED
    + """SELECT CAST(COALESCE(MAX(units), 100) AS BIGINT) AS max_units FROM sized""",
)
def size_leader_bound(spark, sf_dir):
    return sizes.leader_bound(sizes.size_leaders(_sized(spark, sf_dir)))


@query(
    "size_scatter",
    with_tables("listings")
    + _SIZED
    + """SELECT asin, pkg_l, pkg_w, pkg_h, units, est_revenue, side AS longest_side
FROM sized""",
)
def size_scatter(spark, sf_dir):
    return _sized(spark, sf_dir).select(
        "asin", "pkg_l", "pkg_w", "pkg_h", "units", "est_revenue", "longest_side"
    )


@query(
    "oos_active",
    with_tables("listings")
    + """SELECT asin, brand, rank_curr, oos_90 FROM listings
WHERE oos_90 > 0 AND rank_curr > 0""",
)
def oos_active(spark, sf_dir):
    return listings.out_of_stock(tables.listings(spark, sf_dir))


# --- all of it ---------------------------------------------------------------

# Charts of the history dashboard that a query above makes by itself.
_CHARTS = {
    "parents": "parent_synthetic",
    "parent_kpis": "parent_kpis",
    "variant_histogram": "variant_histogram",
    "out_of_stock": "oos_active",
    "price_bins": "price_bins",
    "best_price_bin": "best_price_bin",
    "drops_histogram": "drops_histogram",
    "fbt_coverage": "fbt_coverage",
    "unreadable_prices": "unreadable_price_sample",
    "size_scatter": "size_scatter",
    "size_bands": "size_bands",
    "length_bins": "length_bins",
    "size_compliance": "size_compliance",
    "size_extent": "size_extent",
    "size_leaders": "size_leaders",
}


@query(
    "history_dashboard_rows",
    "\nUNION ALL ".join(
        f"SELECT '{chart}' AS chart, COUNT(*) AS n FROM ({TWINS[name]})" for chart, name in _CHARTS.items()
    ),
)
def history_dashboard_rows(spark, sf_dir):
    """Rows of each chart of the history dashboard, made once and read from the store by a second call."""
    ensure_checkpoint_dir(spark)
    store = ResultStore(spark, f"{spark.sparkContext.getCheckpointDir()}/results")
    files = [f"{sf_dir}/part.parquet", f"{sf_dir}/lineitem.parquet"]
    for _ in range(2):
        charts = stored_dashboard(store, lambda: tables.listings(spark, sf_dir), history_charts, files, "history")
    counts = [
        charts[chart].agg(F.lit(chart).alias("chart"), F.count(F.lit(1)).alias("n")) for chart in _CHARTS
    ]
    return reduce(DataFrame.unionAll, counts)
