from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfsight.functions import bands, dates, numbers, text


def apply(spark, fn, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (
            numbers.currency,
            {"$1,200.50": 1200.5, "-5": -5.0, "1-2": 0.0, "": 0.0, None: 0.0, "nan": 0.0},
        ),
        (
            numbers.percent,
            {"35%": 35.0, "1,000%": 1000.0, "0.25": 0.25, "-": 0.0, None: 0.0, "1d": 0.0},
        ),
        (
            numbers.integer,
            {"1,234": 1234, "abc": 0, None: 0, "12.9": 12, "-12.9": -12, "1e3": 1000},
        ),
        (
            numbers.loose_number,
            {"12,000": 12000.0, "15%": 15.0, "$12.99": None, "inf": None, "NaN": None,
             " 7 ": 7.0, ".5": 0.5, "5.": 5.0, "1f": None, "0x1p3": None},
        ),
        (
            numbers.first_number,
            {"$12.99": 12.99, "from 1,024 to 2": 1024.0, "none": None, None: None,
             "-3": 3.0, "": None},
        ),
        (
            numbers.digits_price,
            {"$1,299.50": 1299.5, "1.2.3": None, "x": None, None: None},
        ),
        (
            numbers.share_pct,
            {"80%": 80.0, " 51 % ": 51.0, "junk": 0.0, None: None, "": 0.0},
        ),
    ],
)
def test_number_parsers(spark, fn, cases):
    assert apply(spark, fn, list(cases)) == list(cases.values())


def test_percent_as_fraction(spark):
    read = lambda c: numbers.percent(c, as_fraction=True)
    assert apply(spark, read, ["25%", "0.25", None]) == [0.25, 0.25, 0.0]


BOUGHT = {
    # text: (fixed, legacy, NULL on failure)
    "2K+ bought in past month": (2000.0, 2000.0, 2000.0),
    "1.5k+ bought": (1500.0, 1500.0, 1500.0),
    "500+ bought": (500.0, 500.0, 500.0),
    "1,000+ bought": (1000.0, 1.0, 1000.0),
    "50 bought in past week": (50.0, 50000.0, 50.0),
    ".k": (0.0, 0.0, None),
    "300": (300.0, 300.0, 300.0),
    "junk": (0.0, 0.0, None),
    None: (0.0, 0.0, None),
}


def test_bought_count(spark):
    texts = list(BOUGHT)
    fixed = apply(spark, numbers.bought_count, texts)
    legacy = apply(spark, lambda c: numbers.bought_count(c, legacy=True), texts)
    or_null = apply(spark, lambda c: numbers.bought_count(c, on_fail=None), texts)
    expected = [BOUGHT[t] for t in texts]
    assert fixed == [e[0] for e in expected]
    assert legacy == [0.0 if e[1] is None else e[1] for e in expected]
    assert or_null == [e[2] for e in expected]


def test_strip_takes_unicode_spaces(spark):
    assert apply(spark, numbers.strip, ["　 B1\xa0\t", "x y"]) == ["B1", "x y"]


def test_dates(spark):
    texts = ["2024-03-05", "2024/03/05", "2024/3/5", "2024-03-05 10:30:00", "bad", None]
    days = apply(
        spark,
        lambda c: dates.days_since(
            dates.parse_timestamp(c), dates.as_of_column("2024-03-06")
        ),
        texts,
    )
    # Whole days are rounded down, so half a day counts as none.
    assert days == [1, 1, 1, 0, None, None]
    months = apply(spark, lambda c: dates.month_name(dates.parse_timestamp(c)), texts)
    assert months == ["March"] * 4 + [None, None]


def test_newness_limit(spark):
    flags = apply(spark, dates.newness, [0, 90, 91], "int")
    assert flags == ["新品 (<90天)", "新品 (<90天)", "老品"]


def test_price_bands(spark):
    prices = [None, -1.0, 0.0, 0.01, 10.0, 10.01, 100.0, 1000.0, 1000.01]
    assert apply(spark, bands.price_band, prices, "double") == [
        "nan", "nan", "nan", "0-10", "0-10", "10-25", "50-100", "100-1000", "1000+",
    ]


def test_size_bands(spark):
    sides = [None, 0.0, 10.0, 10.5, 100.0, 100.1, 999.0, 1000.0]
    assert apply(spark, bands.size_band, sides, "double") == [
        None, None, "0-10cm", "10-20cm", "60-100cm", "100cm+", "100cm+", None,
    ]


def test_range_labels(spark):
    wide = apply(spark, lambda c: bands.range_label(c, c + 9.9), [1.0], "double")
    narrow = apply(spark, lambda c: bands.range_label(c, c + 1.5), [1.0], "double")
    assert (wide, narrow) == (["$1-$10"], ["$1.0-$2.5"])


def test_attribute_map(spark):
    texts = [
        "Color: Red|Size: a:b|Color: Blue|junk|E:",
        "", None, "|||", ":x:y", "a|b:c", "　K　: v ",
    ]
    assert apply(spark, text.attribute_map, texts) == [
        {"Color": "Blue", "Size": "a:b"}, {}, {}, {}, {"x": "y"}, {"b": "c"}, {"K": "v"},
    ]


def test_core_and_short_title(spark):
    titles = ["The Red  Steel Bottle with Lid and a Strap pack", None, "a b"]
    assert apply(spark, text.core_title, titles) == ["red steel bottle lid strap", "未知", ""]
    assert apply(spark, text.short_title, ["x" * 60]) == ["x" * 50 + "..."]


def test_words_match_python(spark):
    import re

    sample = "Café-Crème (2 PACK) snow_man's　红色 瓶子!\xa0x²  ½cup\t\x1cend"
    got = [w for w in apply(spark, text.words, [sample])[0] if w]
    assert got == re.sub(r"[^\w\s]", "", sample.lower()).split()
