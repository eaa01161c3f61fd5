"""Header handling: source spellings to canonical column names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.config import PARAM_PREFIX

# --- Fixed values: headers of a listing export and our names for them --------
LISTING_HEADERS = {
    "ASIN": "asin",
    "商品标题": "title",
    "品牌": "brand",
    "大类目": "category",
    "配送方式": "fulfillment",
    "BuyBox类型": "buybox_type",
    "月销量": "monthly_units",
    "月销售额($)": "monthly_revenue",
    "子体销售额($)": "child_revenue",
    "价格($)": "price",
    "FBA($)": "fba_fee",
    "买家运费($)": "shipping_fee",
    "毛利率": "gross_margin",
    "留评率": "review_rate",
    "月销量增长率": "growth_rate",
    "评分": "rating",
    "评分数": "rating_count",
    "上架时间": "listed_at",
    "上架天数": "days_listed",
    "变体数": "variation_count",
    "大类BSR": "category_rank",
    "详细参数": "params_text",
}

# --- Fixed values: headers a price-history export may use for each key -------
HISTORY_HEADERS = {
    # basic
    "asin": ["ASIN"],
    "parent_asin": ["Parent ASIN"],
    "title": ["Title"],
    "brand": ["Brand"],
    "manufacturer": ["Manufacturer"],
    "model": ["Model"],
    "image": ["Image"],
    "product_group": ["Product Group"],
    "locale": ["Locale"],
    "type": ["Type"],
    # sales and rank
    "sales_text": ["Bought in past month"],
    "rank_curr": ["Sales Rank: Current"],
    "rank_avg_90": ["Sales Rank: 90 days avg."],
    "rank_ref": ["Sales Rank: Reference"],
    "rank_drops": ["Sales Rank: Drops last 90 days"],
    "rank_drop_pct": ["Sales Rank: 90 days drop %"],
    "sales_change": ["90 days change % monthly sold"],
    # price
    "price_curr": ["Buy Box 🚚: Current", "Buy Box: Current"],
    "price_avg_90": ["Buy Box 🚚: 90 days avg."],
    "price_avg_180": ["Buy Box 🚚: 180 days avg."],
    "price_drop_pct": ["Buy Box 🚚: 90 days drop %"],
    "price_new_curr": ["New: Current"],
    # sellers and buy box
    "offers_fba": ["Count of retrieved live offers: New, FBA"],
    "offers_fbm": ["Count of retrieved live offers: New, FBM"],
    "bb_seller": ["Buy Box: Buy Box Seller"],
    "bb_is_fba": ["Buy Box: Is FBA"],
    "used_seller": ["Buy Box Used: Buy Box Used Seller"],
    "share_amz_90": ["Buy Box: % Amazon 90 days"],
    "share_top_90": ["Buy Box: % Top Seller 90 days"],
    "share_top_180": ["Buy Box: % Top Seller 180 days"],
    "share_top_365": ["Buy Box: % Top Seller 365 days"],
    # stock
    "stock_level": ["Buy Box 🚚: Stock"],
    "oos_90": ["Buy Box 🚚: 90 days OOS"],
    # reviews
    "rating_val": ["Reviews: Rating"],
    "rating_count": ["Reviews: Rating Count"],
    # physical
    "item_l": ["Item: Length (cm)"],
    "item_w": ["Item: Width (cm)"],
    "item_h": ["Item: Height (cm)"],
    "item_wt": ["Item: Weight (g)"],
    "item_vol": ["Item: Dimension (cm³)"],
    "pkg_l": ["Package: Length (cm)"],
    "pkg_w": ["Package: Width (cm)"],
    "pkg_h": ["Package: Height (cm)"],
    "pkg_wt": ["Package: Weight (g)"],
    "pkg_vol": ["Package: Dimension (cm³)"],
    "pkg_qty": ["Package: Quantity"],
    # variations
    "var_count": ["Variation Count"],
    "var_asins": ["Variation ASINs"],
    "var_attrs": ["Variation Attributes"],
    "color": ["Color"],
    "size": ["Size"],
    # time and categories
    "listed_date": ["Listed since"],
    "track_date": ["Tracking since"],
    "pub_date": ["Publication Date"],
    "release_date": ["Release Date"],
    "cat_tree": ["Categories: Tree"],
    "cat_root": ["Categories: Root"],
    "cat_sub": ["Categories: Sub"],
    "sub_ranks": ["Sales Rank: Subcategory Sales Ranks"],
    # other
    "fbt": ["Freq. Bought Together"],
    "desc": ["Description & Features: Description"],
    "feat1": ["Description & Features: Feature 1"],
    "feat2": ["Description & Features: Feature 2"],
    "hazmat": ["Hazardous Materials"],
    "trade_in": ["Trade-In Eligible"],
}

# --- Fixed values: history keys that hold numbers ----------------------------
HISTORY_NUMERIC_KEYS = (
    "rank_curr", "rank_avg_90", "rank_drops", "rank_drop_pct", "sales_change",
    "price_curr", "price_avg_90", "price_avg_180", "price_drop_pct",
    "price_new_curr",
    "offers_fba", "offers_fbm",
    "share_amz_90", "share_top_90", "share_top_180", "share_top_365",
    "stock_level", "oos_90",
    "rating_val", "rating_count",
    "item_l", "item_w", "item_h", "item_wt", "item_vol",
    "pkg_l", "pkg_w", "pkg_h", "pkg_wt", "pkg_vol", "pkg_qty",
    "var_count",
)
HISTORY_PRICE_KEYS = (
    "price_curr", "price_avg_90", "price_avg_180", "price_new_curr",
)

# --- Fixed values: words that mark a header as a product attribute -----------
ATTRIBUTE_WORDS = (
    "颜色", "Color", "材质", "Material", "尺寸", "Size", "Style", "Pattern",
    "Group", "Product Group", "Manufacturer", "Brand", "Model", "Binding",
    "Type", "Is FBA", "Fulfillment", "Status", "Department", "Is Prime",
    "Length", "Width", "Height", "Weight", "Dimension",
    "长", "宽", "高", "重", "Item:", "Package:",
)
IMAGE_WORDS = ("image", "img", "photo", "主图", "图片")


def trim_headers(df: DataFrame) -> DataFrame:
    """Headers without surrounding spaces."""
    return df.toDF(*[name.strip() for name in df.columns])


def unique_headers(columns: Sequence[str]) -> list[str]:
    """Number headers that repeat or differ only in case, which Spark cannot tell apart."""
    taken: set[str] = set()
    names = []
    for name in columns:
        candidate, n = name, 1
        while candidate.lower() in taken:
            candidate, n = f"{name}.{n}", n + 1
        taken.add(candidate.lower())
        names.append(candidate)
    return names


def dedupe_headers(df: DataFrame) -> DataFrame:
    """The columns under ``unique_headers``."""
    return df.toDF(*unique_headers(df.columns))


def rename_headers(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by position, so dots and emoji in source headers are harmless."""
    return df.toDF(*[mapping.get(name, name) for name in df.columns])


def canonical_listings(df: DataFrame) -> DataFrame:
    """A listing export under canonical names; other columns keep theirs."""
    return rename_headers(dedupe_headers(trim_headers(df)), LISTING_HEADERS)


def _closeness(header: str, candidate: str) -> int:
    if header.lower() == candidate.lower():
        return 100
    return 100 - len(header) + len(candidate)


def resolve_headers(columns: Sequence[str]) -> dict[str, str]:
    """Best-matching header per history key; keys without a match are absent."""
    resolved = {}
    for key, candidates in HISTORY_HEADERS.items():
        matches = [
            (_closeness(header, candidate), header)
            for candidate in candidates
            for header in columns
            if candidate.lower() in header.lower()
            and not (key == "rank_drops" and "%" in header)
        ]
        # max() keeps the earliest of equally close matches.
        best = max(matches, key=lambda m: m[0], default=(0, ""))
        if best[0] > 0:
            resolved[key] = best[1]
    return resolved


def select_history(df: DataFrame) -> DataFrame:
    """A history export under its keys; one header may serve several keys."""
    df = dedupe_headers(trim_headers(df))
    resolved = resolve_headers(df.columns)
    position = {name: i for i, name in enumerate(df.columns)}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(
        *[F.col(f"c{position[h]}").alias(key) for key, h in resolved.items()]
    )


def attribute_candidates(columns: Sequence[str]) -> list[str]:
    """Headers worth analysing as product attributes, sorted."""
    return sorted(
        {
            c
            for c in columns
            if c.startswith(PARAM_PREFIX) or any(w in c for w in ATTRIBUTE_WORDS)
        }
    )


def image_candidates(columns: Sequence[str]) -> list[str]:
    """Headers that may hold image addresses, in file order."""
    return [c for c in columns if any(w in c.lower() for w in IMAGE_WORDS)]


def existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names that are columns of ``df``, in the order given."""
    have = set(df.columns)
    return [n for n in names if n in have]


def first_existing(
    df: DataFrame, names: Iterable[str], default: Column
) -> Column:
    """The first of the named columns that exists, else the default."""
    found = existing(df, names)
    return F.col(f"`{found[0]}`") if found else default
