"""Queries over dirty exports: cleaning, mapping, attributes and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions import dates, numbers
from shelfsight.operators import clean, kpi, merge, params
from shelfsight.queries import tables
from shelfsight.queries.registry import query
from shelfsight.queries.tables import AS_OF, with_tables
from shelfsight.sources.headers import canonical_listings

PLAIN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _num(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{PLAIN}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def _currency(x: str) -> str:
    kept = f"regexp_replace({x}, '[^0-9.\\-]', '', 'g')"
    return f"COALESCE({_num(kept)}, 0.0)"


def _bare(x: str) -> str:
    return f"replace(replace({x}, '%', ''), ',', '')"


def _int(x: str) -> str:
    bare = f"replace({x}, ',', '')"
    return f"COALESCE(CAST(trunc({_num(bare)}) AS BIGINT), 0)"


def export(spark, sf_dir):
    df = canonical_listings(tables.listing_export(spark, sf_dir))
    return df.withColumn("asin", numbers.strip(F.col("asin")))


@query(
    "clean_currency",
    with_tables("export")
    + f"""SELECT trim(asin) AS asin, {_currency('monthly_revenue')} AS monthly_revenue,
  {_currency('child_revenue')} AS child_revenue, {_currency('price')} AS price,
  {_currency('fba_fee')} AS fba_fee FROM export""",
)
def clean_currency(spark, sf_dir):
    df = clean.clean_money(export(spark, sf_dir))
    return df.select("asin", "monthly_revenue", "child_revenue", "price", "fba_fee")


@query(
    "clean_percent",
    with_tables("export")
    + f"""SELECT trim(asin) AS asin,
  COALESCE({_num(_bare('gross_margin'))}, 0.0) AS gross_margin,
  COALESCE({_num(_bare('review_rate'))}, 0.0) AS review_rate,
  COALESCE({_num(_bare('growth_rate'))}, 0.0) AS growth_rate FROM export""",
)
def clean_percent(spark, sf_dir):
    df = clean.clean_percents(export(spark, sf_dir))
    return df.select("asin", "gross_margin", "review_rate", "growth_rate")


@query(
    "clean_integer",
    with_tables("export")
    + f"""SELECT trim(asin) AS asin, {_int('monthly_units')} AS monthly_units,
  {_int('rating_count')} AS rating_count, {_int('days_listed')} AS days_listed,
  {_int('variation_count')} AS variation_count FROM export""",
)
def clean_integer(spark, sf_dir):
    df = clean.clean_integers(export(spark, sf_dir))
    return df.select(
        "asin", "monthly_units", "rating_count", "days_listed", "variation_count"
    )


_LISTED = """COALESCE(TRY_CAST(listed_at AS TIMESTAMP),
    try_strptime(listed_at, '%Y/%m/%d'))"""


@query(
    "listing_age",
    with_tables("export")
    + f""", dated AS (SELECT trim(asin) AS asin, {_LISTED} AS moment FROM export),
aged AS (SELECT asin, moment, date_diff('day', CAST(moment AS DATE), DATE '{AS_OF}') AS age FROM dated)
SELECT asin, CAST(CAST(moment AS DATE) AS VARCHAR) AS listed_on, age AS days_listed_calc,
  COALESCE(age, 0) AS days_listed, monthname(moment) AS listed_month,
  CASE WHEN COALESCE(age, 0) <= 90 THEN '新品 (<90天)' ELSE '老品' END AS newness
FROM aged""",
)
def listing_age(spark, sf_dir):
    df = clean.clean_integers(export(spark, sf_dir))
    return clean.listing_age(df, AS_OF).select(
        "asin",
        F.date_format("listed_at", "yyyy-MM-dd").alias("listed_on"),
        "days_listed_calc",
        "days_listed",
        "listed_month",
        "newness",
    )


@query(
    "newness_short",
    with_tables("listings")
    + """SELECT CASE WHEN days_listed <= 90 THEN '新品' ELSE '老品' END AS newness,
  COUNT(*) AS products FROM listings GROUP BY 1""",
)
def newness_short(spark, sf_dir):
    df = tables.listings(spark, sf_dir).drop("newness")
    return clean.short_newness(df).groupBy("newness").agg(
        F.count(F.lit(1)).alias("products")
    )


@query(
    "text_defaults",
    with_tables("export")
    + """SELECT trim(asin) AS asin, COALESCE(title, 'Unknown') AS title,
  COALESCE(brand, 'Unknown') AS brand, 'Unknown' AS category,
  COALESCE(fulfillment, 'Unknown') AS fulfillment,
  COALESCE(buybox_type, 'Unknown') AS buybox_type FROM export""",
)
def text_defaults(spark, sf_dir):
    df = clean.fill_text(export(spark, sf_dir).drop("category"))
    return df.select("asin", "title", "brand", "category", "fulfillment", "buybox_type")


@query(
    "image_url",
    with_tables("export")
    + """SELECT trim(asin) AS asin,
  'https://ws-na.amazon-adsystem.com/widgets/q?_encoding=UTF8&Format=_SL250_&ASIN='
  || trim(asin) ||
  '&MarketPlace=US&ID=AsinImage&WS=1&ServiceVersion=20070822' AS image_url FROM export""",
)
def image_url(spark, sf_dir):
    df = export(spark, sf_dir).select("asin")
    return clean.with_image_url(df)


@query("image_column", with_tables("images") + """SELECT "ASIN" AS asin, "Photo" AS image_url FROM images""")
def image_column(spark, sf_dir):
    """The detected image column."""
    return _with_images(spark, sf_dir)


@query("image_override", with_tables("images") + """SELECT "ASIN" AS asin, "主图" AS image_url FROM images""")
def image_override(spark, sf_dir):
    """The chosen image column."""
    return _with_images(spark, sf_dir, "主图")


def _with_images(spark, sf_dir, column=None):
    df = clean.with_image_url(tables.image_export(spark, sf_dir), column)
    return df.select(F.col("ASIN").alias("asin"), "image_url")


_PAIRS = """pairs AS (
  SELECT asin, i, trim(split_part(pair, ':', 1)) AS key,
    trim(substring(pair, position(':' IN pair) + 1)) AS value
  FROM (SELECT asin, unnest(found) AS pair, generate_subscripts(found, 1) AS i
    FROM (SELECT asin, regexp_extract_all(params_text, '([^:|]+):([^|]+)') AS found
      FROM listings))),
long AS (
  SELECT asin, key, value FROM (
    SELECT *, row_number() OVER (PARTITION BY asin, key ORDER BY i DESC) AS back FROM pairs)
  WHERE back = 1)"""


@query(
    "params_long",
    with_tables("listings") + f", {_PAIRS} SELECT asin, key, value FROM long",
)
def params_long(spark, sf_dir):
    return params.params_long(tables.listings(spark, sf_dir), ["asin"])


@query(
    "params_wide",
    with_tables("listings")
    + f""", {_PAIRS}
SELECT l.asin, MAX(CASE WHEN key = 'Color' THEN value END) AS "参数_Color",
  MAX(CASE WHEN key = 'Ratio' THEN value END) AS "参数_Ratio",
  MAX(CASE WHEN key = 'Size' THEN value END) AS "参数_Size",
  MAX(CASE WHEN key = 'Type' THEN value END) AS "参数_Type"
FROM listings l LEFT JOIN long USING (asin) GROUP BY l.asin""",
)
def params_wide(spark, sf_dir):
    df = tables.listings(spark, sf_dir).select("asin", "params_text")
    return params.params_wide(df).drop("params_text")


@query(
    "params_common_keys",
    with_tables("listings")
    + f""", {_PAIRS}
SELECT key, COUNT(*) AS listings FROM long GROUP BY key
HAVING COUNT(*) >= 0.05 * (SELECT COUNT(*) FROM listings)""",
)
def params_common_keys(spark, sf_dir):
    df = tables.listings(spark, sf_dir)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = (
        params.params_long(df, ["asin"])
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("listings"))
    )
    return counted.where(F.col("listings") >= total * 0.05)


@query(
    "history_clean",
    with_tables("history")
    + f"""SELECT trim("ASIN") AS asin, {_num(_bare('"Sales Rank: Current"'))} AS rank_curr,
  {_num(_bare('"Sales Rank: 90 days avg."'))} AS rank_avg_90,
  {_num(_bare('"Sales Rank: 90 days drop %"'))} AS rank_drop_pct,
  {_num(_bare('"Sales Rank: Drops last 90 days"'))} AS rank_drops,
  {_num("replace(" + _bare('"Buy Box 🚚: Current"') + ", '$', '')")} AS price_curr,
  "Buy Box 🚚: Current" AS price_curr_raw,
  {_num(_bare('"Buy Box 🚚: 90 days OOS"'))} AS oos_90,
  {_num(_bare('"Buy Box: % Amazon 90 days"'))} AS share_amz_90,
  {_num(_bare('"Reviews: Rating"'))} AS rating_val,
  {_num(_bare('"Reviews: Rating Count"'))} AS rating_count,
  {_num(_bare('"Package: Width (cm)"'))} AS pkg_w FROM history""",
)
def history_clean(spark, sf_dir):
    return clean.clean_history(tables.history_export(spark, sf_dir)).select(
        numbers.strip(F.col("asin")).alias("asin"),
        "rank_curr",
        "rank_avg_90",
        "rank_drop_pct",
        "rank_drops",
        "price_curr",
        "price_curr_raw",
        "oos_90",
        "share_amz_90",
        "rating_val",
        "rating_count",
        "pkg_w",
    )


@query(
    "bought_count",
    with_tables("listings")
    + """, t AS (SELECT asin, lower(sales_text) AS s FROM listings)
SELECT asin,
  CASE WHEN s IS NULL THEN 0.0
    WHEN s LIKE '%k%' THEN TRY_CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE) * 1000
    WHEN s LIKE '%+%' THEN TRY_CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE)
    ELSE CAST(s AS DOUBLE) END AS bought,
  CASE WHEN s IS NULL THEN 0.0
    WHEN s LIKE '%k%' THEN TRY_CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE) * 1000
    WHEN s LIKE '%+%' THEN TRY_CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE)
    ELSE CAST(s AS DOUBLE) END AS bought_legacy,
  CASE WHEN s LIKE '%k%' THEN TRY_CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE) * 1000
    WHEN s LIKE '%+%' THEN TRY_CAST(regexp_extract(s, '([0-9]+)', 1) AS DOUBLE)
    ELSE CAST(s AS DOUBLE) END AS bought_or_null FROM t""",
)
def bought_count(spark, sf_dir):
    text = F.col("sales_text")
    return tables.listings(spark, sf_dir).select(
        "asin",
        numbers.bought_count(text).alias("bought"),
        numbers.bought_count(text, legacy=True).alias("bought_legacy"),
        numbers.bought_count(text, on_fail=None).alias("bought_or_null"),
    )


_NUMBER = "TRY_CAST(NULLIF(regexp_extract({0}, '{1}', 1), '') AS DOUBLE)"


@query(
    "bought_count_odd",
    with_tables("listings")
    + f""", t AS (SELECT asin, lower({tables.ODD_SALES}) AS s FROM listings),
b AS (SELECT *, replace(s, ',', '') AS bare FROM t)
SELECT asin, s AS sales_text,
  CASE WHEN regexp_matches(bare, '[0-9][0-9.]*[ ]*k')
      THEN COALESCE({_NUMBER.format('bare', '([0-9][0-9.]*)[ ]*k')} * 1000, 0)
    WHEN bare LIKE '%+%' OR bare LIKE '%bought%' THEN COALESCE({_NUMBER.format('bare', '([0-9]+)')}, 0)
    ELSE CAST(bare AS DOUBLE) END AS bought,
  CASE WHEN s LIKE '%k%' THEN COALESCE({_NUMBER.format('s', '([0-9.]+)')} * 1000, 0)
    WHEN s LIKE '%+%' OR s LIKE '%bought%' THEN COALESCE({_NUMBER.format('s', '([0-9]+)')}, 0)
    ELSE CAST(s AS DOUBLE) END AS bought_legacy FROM b""",
)
def bought_count_odd(spark, sf_dir):
    """Sales texts with thousands commas, weeks, decimals and a k without a number."""
    text = F.col("sales_text")
    df = tables.listings(spark, sf_dir).select("asin", F.lower(F.expr(tables.ODD_SALES)).alias("sales_text"))
    return df.select(
        "asin",
        "sales_text",
        numbers.bought_count(text).alias("bought"),
        numbers.bought_count(text, legacy=True).alias("bought_legacy"),
    )


@query(
    "first_number_price",
    with_tables("listings")
    + r"""SELECT asin,
  TRY_CAST(replace(NULLIF(regexp_extract(price_curr_raw, '([0-9][0-9,]*\.?[0-9]*)', 1), ''),
    ',', '') AS DOUBLE) AS first_number,
  TRY_CAST(NULLIF(regexp_replace(price_curr_raw, '[^0-9.]', '', 'g'), '') AS DOUBLE)
    AS digits_price FROM listings""",
)
def first_number_price(spark, sf_dir):
    raw = F.col("price_curr_raw")
    return tables.listings(spark, sf_dir).select(
        "asin",
        numbers.first_number(raw).alias("first_number"),
        numbers.digits_price(raw).alias("digits_price"),
    )


@query(
    "share_pct",
    with_tables("history")
    + """SELECT trim("ASIN") AS asin, CASE WHEN "Buy Box: % Amazon 90 days" IS NOT NULL THEN
  COALESCE(TRY_CAST(trim(replace("Buy Box: % Amazon 90 days", '%', '')) AS DOUBLE), 0.0)
  END AS share FROM history""",
)
def share_pct(spark, sf_dir):
    df = tables.history_export(spark, sf_dir)
    return df.select(
        numbers.strip(F.col("ASIN")).alias("asin"),
        numbers.share_pct(F.col("`Buy Box: % Amazon 90 days`")).alias("share"),
    )


# One id in seven is spelled so that it matches no listing.
_HISTORY_SIDE = """hist AS (
  SELECT CASE WHEN CAST(substr(trim("ASIN"), 2) AS BIGINT) % 7 = 3 THEN 'X' ELSE '' END
    || trim("ASIN") AS asin, "Title" AS title, "Brand" AS brand,
    CASE WHEN "Parent ASIN" IS NULL OR trim("Parent ASIN") = '' THEN trim("ASIN")
      ELSE "Parent ASIN" END AS parent_asin,
    CASE WHEN "Sales Rank: Drops last 90 days" IS NOT NULL
      THEN CAST("Sales Rank: Drops last 90 days" AS DOUBLE) END AS rank_drops
  FROM history)"""


def _merge_sides(spark, sf_dir):
    left = export(spark, sf_dir).select("asin", "title", "brand")
    history = clean.clean_history(tables.history_export(spark, sf_dir))
    number = F.substring(F.trim("asin"), 2, 12).cast("bigint")
    spelled = F.concat(F.when(number % 7 == 3, "X").otherwise(""), F.trim("asin"))
    right = history.withColumn("asin", spelled).select(
        "asin", "title", "brand", "parent_asin", "rank_drops"
    )
    return left, right


@query(
    "merge_history",
    with_tables("export", "history")
    + f""", {_HISTORY_SIDE}
SELECT trim(e.asin) AS asin, e.title AS title, e.brand AS brand, h.title AS title_history,
  h.brand AS brand_history, h.parent_asin AS parent_asin, h.rank_drops AS rank_drops
FROM export e LEFT JOIN hist h ON trim(e.asin) = h.asin""",
)
def merge_history(spark, sf_dir):
    return merge.merge_history(*_merge_sides(spark, sf_dir))


@query(
    "merge_history_both_suffix",
    with_tables("export", "history")
    + f""", {_HISTORY_SIDE}
SELECT trim(e.asin) AS asin, e.title AS title_main, e.brand AS brand_main,
  h.title AS title_history, h.brand AS brand_history, h.parent_asin AS parent_asin,
  h.rank_drops AS rank_drops
FROM export e LEFT JOIN hist h ON trim(e.asin) = h.asin""",
)
def merge_history_both_suffix(spark, sf_dir):
    left, right = _merge_sides(spark, sf_dir)
    return merge.merge_history(left, right, suffixes=("_main", "_history"))


@query(
    "merge_orders_lines",
    """WITH l AS (SELECT 'O' || o_orderkey AS asin, o_totalprice AS price,
  o_orderpriority AS tier FROM orders),
h AS (SELECT 'O' || l_orderkey AS asin, l_linenumber AS line, l_extendedprice AS price,
  'P' || l_partkey AS parent_asin FROM lineitem)
SELECT l.asin, l.price AS price, l.tier, h.line, h.price AS price_history, h.parent_asin
FROM l LEFT JOIN h ON l.asin = h.asin""",
)
def merge_orders_lines(spark, sf_dir):
    """One-to-many merge of the two largest tables."""
    left = tables.read(spark, sf_dir, "orders").select(
        F.concat(F.lit("O"), "o_orderkey").alias("asin"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("tier"),
    )
    right = tables.read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("O"), "l_orderkey").alias("asin"),
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("price"),
        F.concat(F.lit("P"), "l_partkey").alias("parent_asin"),
    )
    return merge.merge_history(left, right)


@query(
    "data_quality",
    with_tables("export")
    + f""", doubled AS (SELECT * FROM export UNION ALL
  SELECT * FROM export WHERE brand = 'Brand#7')
SELECT COUNT(*) AS rows, COUNT(*) - COUNT(DISTINCT trim(asin)) AS duplicate_ids,
  COUNT(*) - COUNT(growth_rate) AS missing_growth,
  COUNT(CASE WHEN regexp_matches(CAST(price AS VARCHAR), '[0-9]') THEN 1 END) AS valid_prices
FROM doubled""",
)
def data_quality(spark, sf_dir):
    df = export(spark, sf_dir)
    doubled = df.unionByName(df.where(F.col("brand") == "Brand#7"))
    cleaned = clean.clean_listings(doubled, AS_OF, keep_raw=True)
    return kpi.data_quality(cleaned, "growth_rate_raw", "price_raw")


@query(
    "unreadable_price_sample",
    with_tables("listings")
    + """SELECT asin, price_curr_raw AS raw_value FROM listings
WHERE regexp_extract(price_curr_raw, '([0-9])', 1) = '' ORDER BY asin, raw_value LIMIT 10""",
)
def unreadable_price_sample(spark, sf_dir):
    raw = F.col("price_curr_raw")
    df = tables.listings(spark, sf_dir).withColumn("read", numbers.first_number(raw))
    return kpi.unreadable_sample(df, "price_curr_raw", "read")


@query(
    "order_dates",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS listed_on,
  date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-11-04') AS days_listed,
  monthname(o_orderdate) AS listed_month,
  CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-11-04') <= 90
    THEN '新品 (<90天)' ELSE '老品' END AS newness FROM orders""",
)
def order_dates(spark, sf_dir):
    """Dates read back from text on a table of its own."""
    text = F.date_format("o_orderdate", "yyyy/MM/dd")
    at = dates.parse_timestamp(text)
    age = dates.days_since(at, dates.as_of_column(AS_OF))
    return tables.read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format(at, "yyyy-MM-dd").alias("listed_on"),
        age.alias("days_listed"),
        dates.month_name(at).alias("listed_month"),
        dates.newness(age).alias("newness"),
    )
