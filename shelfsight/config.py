"""Settings and the fixed values that results must reproduce."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScoreConfig:
    """Weights and thresholds of the opportunity score."""

    w_sales: float = 30
    w_profit: float = 20
    w_comp: float = 25
    w_growth: float = 25
    target_sales: float = 300
    max_reviews: float = 200
    price_min: float = 15
    price_max: float = 80

    def __post_init__(self) -> None:
        if self.target_sales <= 0 or self.max_reviews <= 0:
            raise ValueError("target_sales and max_reviews must be positive")

    @property
    def total_weight(self) -> float:
        total = self.w_sales + self.w_profit + self.w_comp + self.w_growth
        return total if total != 0 else 1

    def weight_shares(self) -> dict[str, int]:
        """Each weight as a whole percentage of all weights."""
        return {
            name: round(getattr(self, name) / self.total_weight * 100)
            for name in ("w_sales", "w_profit", "w_comp", "w_growth")
        }


# The preset of the interactive app, which differs from the defaults above.
APP_SCORE = ScoreConfig(
    w_sales=35,
    w_profit=20,
    w_comp=25,
    w_growth=20,
    target_sales=300,
    max_reviews=250,
    price_min=18,
    price_max=90,
)


@dataclass(frozen=True)
class SizeLimits:
    """Parcel limits in centimetres (36 x 25 x 25 inches)."""

    length: float = 91.44
    width: float = 63.5
    height: float = 63.5


# --- Fixed values: labels that appear in results -----------------------------
UNKNOWN = "Unknown"
UNKNOWN_TITLE = "未知"
NEW_LABEL = "新品 (<90天)"
OLD_LABEL = "老品"
NEW_LABEL_SHORT = "新品"
INDEPENDENT_PARENT = "独立产品"
PARAM_PREFIX = "参数_"
NEW_WITHIN_DAYS = 90
LOW_RATING = 3.8

# --- Fixed values: tags of the opportunity score, in the order they are tried -
TAG_BEST_SELLER = "🔥月销1k+"
TAG_FREQUENT_SALES = "📉高频出单"
TAG_LOW_PRICE = "⚠️低价"
TAG_NEW_STAR = "✨新星"
TAG_PLATFORM_SELLS = "🦖AMZ垄断"
TAG_FEW_SELLERS = "👥卖家少"
TAG_OUT_OF_STOCK = "🚨缺货"
TAG_IMPROVABLE = "🛠️改良机会"

# --- Fixed values: product image address built from a listing id -------------
IMAGE_URL_HEAD = (
    "https://ws-na.amazon-adsystem.com/widgets/q?_encoding=UTF8"
    "&Format=_SL250_&ASIN="
)
IMAGE_URL_TAIL = "&MarketPlace=US&ID=AsinImage&WS=1&ServiceVersion=20070822"

# --- Fixed values: words the title keyword count leaves out ------------------
KEYWORD_STOP_WORDS = (
    "the", "for", "and", "with", "of", "to", "in", "a", "on", "at",
    "pack", "pcs", "set", "new", "black", "white", "unknown", "nan", "generic",
)

# --- Fixed values: words dropped from a title when it names a product family -
TITLE_FILLER_WORDS = (
    "pack", "set", "size", "color", "with", "for", "the", "and", "new",
)

# --- Fixed values: upper edges of right-closed bands -------------------------
PRICE_BAND_EDGES = (0, 10, 25, 50, 100, 1000, None)
SIZE_BAND_EDGES = (0, 10, 20, 30, 45, 60, 100, 999)
SIZE_BAND_LABELS = (
    "0-10cm", "10-20cm", "20-30cm", "30-45cm", "45-60cm", "60-100cm", "100cm+",
)
