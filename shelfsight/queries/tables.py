"""Listing and history tables derived from the trade tables of a data folder.

The expressions are plain SQL that Spark and DuckDB read alike, so a query and
its SQL twin start from the same rows. The trade tables hold no missing or
dirty values; the exports below add them by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.functions import dates
from shelfsight.session import configure
from shelfsight.sources.headers import LISTING_HEADERS

AS_OF = "2001-11-04"
GROWTH_SPLIT = "1999-01-01"

SALES = {
    "units": "CAST(SUM(l_quantity) AS BIGINT)",
    "cents": "SUM(CAST(FLOOR(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT))",
    "last_ship": "MAX(l_shipdate)",
    "units_after": f"CAST(SUM(CASE WHEN l_shipdate >= DATE '{GROWTH_SPLIT}' "
    "THEN l_quantity ELSE 0 END) AS BIGINT)",
    "lines": "COUNT(*)",
    "open_lines": "CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT)",
    "return_lines": "CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT)",
    "return_units": "CAST(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) "
    "AS BIGINT)",
    "suppliers": "COUNT(DISTINCT l_suppkey)",
}

FACTS = {
    "pk": "p_partkey",
    "asin": "'P' || LPAD(CAST(p_partkey AS STRING), 12, '0')",
    "title": "p_name",
    "brand": "p_brand",
    "category": "p_type",
    "side": "CAST(p_size AS BIGINT)",
    "price_cents": "CAST(FLOOR((p_retailprice - 899) * 100 + 0.5) AS BIGINT)",
    "units": "COALESCE(units, 0)",
    "cents": "CAST(COALESCE(cents, 0) AS BIGINT)",
    "last_ship": "last_ship",
    "units_after": "COALESCE(units_after, 0)",
    "lines": "COALESCE(lines, 0)",
    "open_lines": "COALESCE(open_lines, 0)",
    "return_lines": "COALESCE(return_lines, 0)",
    "return_units": "COALESCE(return_units, 0)",
    "suppliers": "COALESCE(suppliers, 0)",
}

_PRICE_TEXT = (
    "'$' || CAST(CAST(FLOOR(price_cents / 100) AS BIGINT) AS STRING) || '.' "
    "|| LPAD(CAST(price_cents % 100 AS STRING), 2, '0')"
)
_TENTHS = "25 + (pk * 7) % 26"


def _thousands(name: str) -> str:
    """A count as text with a thousands comma."""
    return (
        f"CASE WHEN {name} >= 1000 THEN CAST(CAST(FLOOR({name} / 1000) AS BIGINT) "
        f"AS STRING) || ',' || LPAD(CAST({name} % 1000 AS STRING), 3, '0') "
        f"ELSE CAST({name} AS STRING) END"
    )


LISTING = {
    "asin": "asin",
    "title": "title",
    "brand": "brand",
    "category": "category",
    "price": "CAST(price_cents AS DOUBLE) / 100",
    "monthly_units": "units",
    "monthly_revenue": "CAST(cents AS DOUBLE) / 100",
    "growth_rate": "COALESCE(CAST(units_after AS DOUBLE) / "
    "NULLIF(units - units_after, 0) - 1, 0)",
    "growth_raw": "CASE WHEN pk % 59 <> 0 THEN CAST(units_after AS DOUBLE) / "
    "NULLIF(units - units_after, 0) - 1 END",
    "listed_at": "CASE WHEN pk % 19 <> 0 THEN last_ship END",
    "fulfillment": "CASE WHEN open_lines * 2 >= lines THEN 'FBA' ELSE 'FBM' END",
    "buybox_type": "CASE WHEN return_lines * 3 >= lines THEN 'AMZ' ELSE 'FBA' END",
    "rating": f"CASE WHEN pk % 17 <> 0 THEN CAST({_TENTHS} AS DOUBLE) / 10 END",
    "rating_count": "lines * (pk % 13)",
    "category_rank": "1 + (pk * 31) % 500",
    "fbt": "CASE WHEN pk % 4 <> 0 THEN 'also ' || title END",
    "oos_90": "CAST(pk % 30 AS DOUBLE)",
    "rank_curr": "CASE WHEN pk % 23 = 0 THEN 0.0e0 ELSE CAST((pk * 7919) % 50000 AS DOUBLE) END",
    "rank_drops": "CAST((pk * 11) % 95 AS DOUBLE)",
    "pkg_l": "CAST(side * 2 AS DOUBLE)",
    "pkg_w": "side * 1.5e0",
    "pkg_h": "CASE WHEN pk % 29 <> 0 THEN CAST(pk % 70 AS DOUBLE) END",
    "sales_text": "CASE WHEN pk % 5 = 0 THEN NULL "
    "WHEN pk % 7 = 0 THEN CAST(units AS STRING) "
    "WHEN units >= 1000 THEN CAST(CAST(FLOOR(units / 1000) AS BIGINT) AS STRING) "
    "|| 'K+ bought in past month' "
    "ELSE CAST(CAST(FLOOR(units / 50) AS BIGINT) * 50 AS STRING) || '+ bought' END",
    "price_curr_raw": f"CASE WHEN pk % 22 = 0 THEN 'n/a' ELSE {_PRICE_TEXT} END",
    "params_text": "CASE WHEN pk % 31 = 0 THEN NULL ELSE "
    "'Color:' || SUBSTRING(title, 1, 3) || '|Type: ' || category || '|Size:' "
    "|| CAST(side AS STRING) || CASE WHEN pk % 9 = 0 "
    "THEN '|junk|Color: Blue |Ratio:1:2|E:' ELSE '' END END",
}

LISTING_EXPORT = {
    "ASIN": "' ' || asin || '  '",
    "商品标题": "CASE WHEN pk % 37 <> 0 THEN title END",
    "品牌": "CASE WHEN pk % 41 <> 0 THEN brand END",
    "大类目": "category",
    "配送方式": "CASE WHEN pk % 43 <> 0 THEN "
    "CASE WHEN open_lines * 2 >= lines THEN 'FBA' ELSE 'FBM' END END",
    "BuyBox类型": "CASE WHEN return_lines * 3 >= lines THEN 'AMZ' ELSE 'FBA' END",
    "月销量": f"CASE WHEN pk % 47 = 0 THEN 'abc' ELSE {_thousands('units')} END",
    "月销售额($)": "CASE WHEN pk % 53 = 0 THEN '1-2' WHEN pk % 51 = 0 THEN NULL ELSE "
    "'$' || CAST(CAST(FLOOR(cents / 100000) AS BIGINT) AS STRING) || ',' "
    "|| LPAD(CAST(CAST(FLOOR(cents / 100) AS BIGINT) % 1000 AS STRING), 3, '0') || '.' "
    "|| LPAD(CAST(cents % 100 AS STRING), 2, '0') END",
    "子体销售额($)": "'-' || CAST(1 + pk % 900 AS STRING)",
    "价格($)": f"CASE WHEN pk % 22 = 0 THEN 'n/a' ELSE {_PRICE_TEXT} END",
    "FBA($)": "'US$ ' || CAST(pk % 7 AS STRING) || '.5'",
    "毛利率": "CAST(pk % 60 AS STRING) || '%'",
    "留评率": "CASE WHEN pk % 8 = 0 THEN '1,0' || CAST(10 + pk % 90 AS STRING) || '%' "
    "WHEN pk % 8 = 1 THEN '-' ELSE CAST(pk % 9 AS STRING) || '.25' END",
    "月销量增长率": "CASE WHEN pk % 59 = 0 THEN NULL ELSE "
    "CAST(CAST(FLOOR((COALESCE(CAST(units_after AS DOUBLE) / "
    "NULLIF(units - units_after, 0), 1) - 1) * 100) AS BIGINT) AS STRING) || '%' END",
    "评分": f"CAST(CAST(FLOOR(({_TENTHS}) / 10) AS BIGINT) AS STRING) || '.' "
    f"|| CAST(({_TENTHS}) % 10 AS STRING)",
    "评分数": f"CASE WHEN pk % 13 = 0 THEN NULL ELSE {_thousands('lines * (pk % 13)')} END",
    "上架时间": "CASE WHEN pk % 19 = 0 THEN NULL WHEN pk % 61 = 0 THEN 'bad' "
    "WHEN pk % 2 = 0 THEN CAST(CAST(last_ship AS DATE) AS STRING) "
    "ELSE REPLACE(CAST(CAST(last_ship AS DATE) AS STRING), '-', '/') END",
    "上架天数": "'0'",
    "变体数": "CAST(pk % 5 AS STRING)",
}

HISTORY_EXPORT = {
    "ASIN": "asin || ' '",
    "Parent ASIN": "CASE WHEN pk % 3 = 0 THEN NULL WHEN pk % 3 = 1 THEN '   ' "
    "ELSE 'P' || LPAD(CAST(pk - pk % 10 AS STRING), 12, '0') END",
    "Title": "title || ' (history)'",
    "Brand": "brand",
    "Bought in past month": LISTING["sales_text"],
    "Sales Rank: Current": "CASE WHEN pk % 23 = 0 THEN '0' "
    f"ELSE {_thousands('((pk * 7919) % 50000)')} END",
    "Sales Rank: 90 days avg.": "CAST((pk * 13) % 4000 AS STRING) || '.5'",
    "Sales Rank: 90 days drop %": "CAST(pk % 100 AS STRING) || '%'",
    "Sales Rank: Drops last 90 days": "CASE WHEN pk % 26 <> 0 "
    "THEN CAST((pk * 11) % 95 AS STRING) END",
    "Buy Box 🚚: Current": LISTING["price_curr_raw"],
    "Buy Box 🚚: 90 days OOS": "CASE WHEN pk % 27 <> 0 "
    "THEN CAST(pk % 30 AS STRING) || '%' END",
    "Buy Box: % Amazon 90 days": "CASE WHEN pk % 28 = 0 THEN NULL "
    "WHEN pk % 33 = 0 THEN 'unknown' ELSE CAST(LEAST(100, "
    "CAST(FLOOR(return_units * 200 / NULLIF(units, 0)) AS BIGINT)) AS STRING) || ' %' END",
    "Count of retrieved live offers: New, FBA": "CAST(suppliers % 4 AS STRING)",
    "Count of retrieved live offers: New, FBM": "CASE WHEN pk % 34 <> 0 "
    "THEN CAST(pk % 3 AS STRING) END",
    "Reviews: Rating": LISTING_EXPORT["评分"],
    "Reviews: Rating Count": LISTING_EXPORT["评分数"],
    "Package: Length (cm)": "CAST(side * 2 AS STRING)",
    "Package: Width (cm)": "CAST(side AS STRING) || '.5'",
    "Package: Height (cm)": "CASE WHEN pk % 29 <> 0 THEN CAST(pk % 70 AS STRING) END",
    "Freq. Bought Together": LISTING["fbt"],
}

# An export with columns that may hold images; the first one holds none.
IMAGE_EXPORT = {
    "ASIN": "asin",
    "Image note": "CASE WHEN pk % 3 <> 0 THEN 'front view' END",
    "Photo": "CASE WHEN pk % 5 <> 0 THEN 'https://img.example/' || asin || '.jpg' END",
    "主图": "'http://other.example/' || CAST(pk AS STRING)",
}

# Sales texts as they rarely come: thousands commas, weeks, a lone k.
ODD_SALES = (
    "CASE WHEN CAST(SUBSTRING(asin, 2, 12) AS BIGINT) % 5 = 0 THEN '1,' || "
    "LPAD(CAST(CAST(SUBSTRING(asin, 2, 12) AS BIGINT) % 1000 AS STRING), 3, '0') || '+ bought' "
    "WHEN CAST(SUBSTRING(asin, 2, 12) AS BIGINT) % 5 = 1 THEN "
    "CAST(CAST(SUBSTRING(asin, 2, 12) AS BIGINT) % 90 AS STRING) || ' bought in past week' "
    "WHEN CAST(SUBSTRING(asin, 2, 12) AS BIGINT) % 5 = 2 THEN '.k bought' "
    "WHEN CAST(SUBSTRING(asin, 2, 12) AS BIGINT) % 5 = 3 THEN "
    "'1.' || CAST(CAST(SUBSTRING(asin, 2, 12) AS BIGINT) % 10 AS STRING) || 'K+' "
    "ELSE CAST(CAST(SUBSTRING(asin, 2, 12) AS BIGINT) % 700 AS STRING) END"
)


def _exprs(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS `{name}`" for name, sql in columns.items()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One trade table."""
    return configure(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part with its sales; only the columns a query uses survive."""
    sales = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(*[F.expr(sql).alias(name) for name, sql in SALES.items()])
    )
    parts = read(spark, sf_dir, "part")
    joined = parts.join(sales, parts.p_partkey == sales.l_partkey, "left")
    return joined.selectExpr(*_exprs(FACTS))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed listing table with its history columns."""
    typed = facts(spark, sf_dir).selectExpr(*_exprs(LISTING))
    age = dates.days_since(F.col("listed_at"), dates.as_of_column(AS_OF))
    return typed.withColumn(
        "days_listed", F.coalesce(age, F.lit(0).cast("bigint"))
    ).withColumns(
        {
            "listed_month": dates.month_name(F.col("listed_at")),
            "newness": dates.newness(F.col("days_listed")),
        }
    )


def listing_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as an export has them: all text, source headers, dirty cells."""
    return facts(spark, sf_dir).selectExpr(*_exprs(LISTING_EXPORT))


def history_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price history as an export has it."""
    return facts(spark, sf_dir).selectExpr(*_exprs(HISTORY_EXPORT))


def image_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with columns that may hold images."""
    return facts(spark, sf_dir).selectExpr(*_exprs(IMAGE_EXPORT))


def _select(columns: dict[str, str], source: str) -> str:
    body = ",\n    ".join(f'{sql} AS "{name}"' for name, sql in columns.items())
    return f"SELECT\n    {body}\n  FROM {source}"


def with_tables(*wanted: str) -> str:
    """SQL ``WITH`` head that defines the tables above for the twin."""
    sales = ", ".join(f"{sql} AS {name}" for name, sql in SALES.items())
    listing_names = {LISTING_HEADERS[h]: sql for h, sql in LISTING_EXPORT.items()}
    tables = {
        "sales": f"SELECT l_partkey, {sales} FROM lineitem GROUP BY l_partkey",
        "facts": _select(FACTS, "part LEFT JOIN sales ON p_partkey = l_partkey"),
        "typed": _select(LISTING, "facts"),
        "listings": f"""SELECT *,
    COALESCE(date_diff('day', CAST(listed_at AS DATE), DATE '{AS_OF}'), 0) AS days_listed,
    monthname(listed_at) AS listed_month,
    CASE WHEN COALESCE(date_diff('day', CAST(listed_at AS DATE), DATE '{AS_OF}'), 0) <= 90
      THEN '新品 (<90天)' ELSE '老品' END AS newness
  FROM typed""",
        "export": _select(listing_names, "facts"),
        "history": _select(HISTORY_EXPORT, "facts"),
        "images": _select(IMAGE_EXPORT, "facts"),
    }
    needs = {
        "listings": ["sales", "facts", "typed", "listings"],
        "export": ["sales", "facts", "export"],
        "history": ["sales", "facts", "history"],
        "images": ["sales", "facts", "images"],
    }
    names = list(dict.fromkeys(n for w in wanted for n in needs[w]))
    return "WITH " + ",\n".join(f"{n} AS (\n  {tables[n]})" for n in names)
