from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfsight.config import APP_SCORE, ScoreConfig
from shelfsight.operators import (
    attributes,
    brand,
    clean,
    common,
    correlation,
    keywords,
    kpi,
    listings,
    merge,
    params,
    pareto,
    parents,
    prices,
    score,
    sizes,
)
from shelfsight.plans.brief import market_brief
from shelfsight.plans.dashboard import listing_dashboard

SCHEMA = (
    "market string, asin string, title string, brand string, category string, "
    "monthly_units bigint, monthly_revenue double, price double, growth_rate double, "
    "rating double, rating_count bigint, days_listed bigint, newness string, "
    "listed_month string, fulfillment string, buybox_type string, "
    "category_rank bigint, params_text string"
)


def sample(n=300, seed=1, markets=("a", "b", "c")):
    """Random listings in which market 'a' and brand 'Unknown' hold most rows."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        days = rng.choice([0, 30, 90, 91, 400])
        out.append(
            (
                rng.choice([markets[0], *markets]),
                f"B{i:04d}",
                rng.choice(["red steel bottle", "blue cup", "red cup 2024"]),
                rng.choice(["Unknown", "Unknown", "x", "y", "z"]),
                rng.choice(["c1", "c2"]),
                rng.choice([0, 0, 5, 10, 200]),
                rng.choice([0.0, 0.0, 0.0, 19.99, 5.01, round(rng.random() * 900, 2)]),
                rng.choice([9.99, 9.99, 10.0, round(rng.random() * 90 + 1, 2)]),
                rng.choice([None, 0.25, -0.5]),
                rng.choice([None, 3.0, 3.79, 3.8, 4.5]),
                rng.choice([0, 7, 1024]),
                days,
                "新品 (<90天)" if days <= 90 else "老品",
                rng.choice([None, "May", "June"]),
                rng.choice(["FBA", "FBM"]),
                rng.choice(["AMZ", "FBA"]),
                rng.choice([None, 5, 17]),
                rng.choice(["Color:Red|Size:3", "Color:Blue", None]),
            )
        )
    return out


@pytest.fixture(scope="module")
def shop(spark):
    return spark.createDataFrame(sample(), SCHEMA).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- cleaning ----------------------------------------------------------------


def test_age_fallback_is_per_market(spark):
    rows = [("a", "0", "2024-01-01"), ("a", "0", "bad"), ("b", "5", "2024-01-01"), ("b", "0", None)]
    df = spark.createDataFrame(rows, "market string, days_listed string, listed_at string")
    got = clean.listing_age(clean.clean_integers(df), "2024-01-11", ["market"])
    assert sorted((r.market, r.days_listed) for r in got.collect()) == [
        ("a", 0), ("a", 10), ("b", 0), ("b", 5),
    ]


def test_missing_date_and_zero_days_count_as_new(spark):
    df = spark.createDataFrame([(None,)], "listed_at string")
    assert one(clean.listing_age(df, "2024-01-01")).newness == "新品 (<90天)"


def test_clean_listings_keeps_raw_text(spark):
    df = spark.createDataFrame([("$1,2", None, "7%")], "price string, brand string, growth_rate string")
    row = one(clean.clean_listings(df, keep_raw=True))
    assert (row.price, row.price_raw, row.brand, row.growth_rate) == (12.0, "$1,2", "Unknown", 7.0)


def test_image_column_choice(spark):
    df = spark.createDataFrame(
        [(" B1 ", None, "n/a", "http://x/1")], "asin string, `图片` string, imgname string, Photo string"
    )
    assert clean.find_image_column(df) == "Photo"
    assert one(clean.with_image_url(df)).image_url == "http://x/1"
    assert one(clean.with_image_url(df, "imgname")).image_url == "n/a"
    built = one(clean.with_image_url(df.select("asin"))).image_url
    assert "ASIN=B1&" in built
    assert one(clean.with_image_url(df.select("imgname"))).image_url is None


def test_params_keep_common_keys_only(spark):
    rows = [(i, "A:1|B:2" if i == 0 else "A:1" if i < 50 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, params_text string")
    assert params.common_keys(df) == ["A"]
    wide = params.params_wide(df)
    assert wide.columns == ["id", "params_text", "参数_A"]
    assert wide.where(F.col("参数_A") == "1").count() == 50
    assert params.params_long(df, ["id"]).count() == 51


# --- merge -------------------------------------------------------------------


def merged_rows(spark, left, right, **kw):
    a = spark.createDataFrame(left, "asin string, title string")
    b = spark.createDataFrame(right, "asin string, parent_asin string, title string")
    return merge.merge_history(a, b, **kw)


def test_merge_fans_out_trims_and_fills(spark):
    left = [(" B1 ", "l1"), ("B2", "l2"), (None, "l3"), ("", "l4")]
    right = [("B1", "  ", "h1"), ("B1 ", "P", "h2"), (None, None, "h3"), ("B9", "", "h4")]
    got = merged_rows(spark, left, right)
    assert got.columns == ["asin", "title", "parent_asin", "title_history"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [
            ("B1", "l1", "B1", "h1"), ("B1", "l1", "P", "h2"), ("B2", "l2", None, None),
            (None, "l3", None, None), ("", "l4", None, None),
        ],
        key=str,
    )


def test_merge_suffixes_and_missing_key(spark):
    got = merged_rows(spark, [("B1", "l")], [("B1", "P", "h")], suffixes=("_main", "_history"))
    assert got.columns == ["asin", "title_main", "parent_asin", "title_history"]
    listing = spark.createDataFrame([("B1",)], "asin string")
    with pytest.raises(ValueError, match="asin"):
        merge.merge_history(listing, spark.createDataFrame([(1,)], "x int"))


@pytest.mark.parametrize("rows_per_task", [merge.ROWS_PER_TASK, 8, 1])
def test_merge_hot_ids_match_brute_force(spark, rows_per_task):
    left = [("HOT", f"l{i}") for i in range(60)] + [(f"B{i}", "l") for i in range(90)]
    right = [("HOT", None, f"h{i}") for i in range(70)] + [(f"B{i}", None, "h") for i in range(0, 90, 2)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(str, merged_rows(spark, left, right, rows_per_task=rows_per_task).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_id = {}
    for asin, _, title in right:
        by_id.setdefault(asin, []).append(title)
    want = sum(len(by_id.get(asin, [None])) for asin, _ in left)
    assert len(got) == want
    assert len(set(got)) == want


def test_a_hot_history_id_is_split_and_rows_without_an_id_are_spread(spark):
    history = spark.range(4000).selectExpr("IF(id < 3000, 'HOT', 'B' || id) AS asin", "'h' || id AS note")
    listings = spark.range(3000).selectExpr("CASE WHEN id = 0 THEN ' HOT ' WHEN id > 999 THEN 'B' || id END AS asin", "'l' || id AS title")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        merged = merge.merge_history(listings, history, rows_per_task=300).withColumn("task", F.spark_partition_id())
        per_task = merged.groupBy("task").agg(
            F.count_if(F.col("asin") == "HOT").alias("hot"), F.count_if(F.col("asin").isNull()).alias("none")
        ).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r.hot for r in per_task) == 3000 and max(r.hot for r in per_task) < 1500
    assert sum(r.none for r in per_task) == 999 and max(r.none for r in per_task) < 400


def test_merge_reads_each_side_once(spark, tmp_path):
    spark.range(100).selectExpr("'B' || id AS asin", "id AS left_value").write.parquet(str(tmp_path / "l"))
    spark.range(100).selectExpr("'B' || id AS asin", "id AS right_value").write.parquet(str(tmp_path / "r"))
    merged = merge.merge_history(spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "r")))
    assert merged.count() == 100
    text = merged._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^]]*left_value", text)) == 1
    assert len(re.findall(r"FileScan parquet \[[^]]*right_value", text)) == 1
    # The sketch reads the ids of the history, and nothing reads the listings again.
    assert len(re.findall(r"FileScan parquet", text)) <= 3 and text.count("Join") == 1


# --- order statistics --------------------------------------------------------


def brute_quantile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    lo = int(at)
    hi = min(lo + 1, len(values) - 1)
    return values[lo] + (values[hi] - values[lo]) * (at - lo)


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_match_brute_force(spark, seed):
    rng = random.Random(seed)
    # One value holds a third of the rows; others are negative, tiny and huge.
    values = [7] * 100 + [rng.choice([-1, 1]) * rng.randrange(10 ** rng.randrange(1, 9)) for _ in range(200)]
    rows = [(rng.choice("aab"), v) for v in values]
    df = spark.createDataFrame(rows, "market string, v bigint")
    probabilities = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    hist = common.histogram(df, F.col("v"), ["market"])
    for row in common.quantiles_of(hist, probabilities, ["market"]).collect():
        mine = [v for m, v in rows if m == row.market]
        for name, p in probabilities.items():
            assert row[name] == pytest.approx(brute_quantile(mine, p), rel=1e-12), name


def test_running_totals_match_brute_force(spark):
    rng = random.Random(5)
    values = [rng.randrange(-50, 5000) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    hist = common.histogram(df, F.col("v"), total=F.sum("v"))
    for descending in (False, True):
        got = common.running_totals(hist, ["n", "total"], descending=descending).collect()
        for r in got:
            earlier = [v for v in values if (v > r.value if descending else v < r.value)]
            assert (r.before_n, r.before_total) == (len(earlier), sum(earlier))
            assert (r.all_n, r.all_total) == (len(values), sum(values))


def test_equal_width_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 19, 20, 20]], "v double")
    got = sorted((r.bin, r.n) for r in prices.measure_histogram(df, "v").collect())
    assert got == [(0, 1), (1, 1), (19, 3)]
    same = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert one(prices.measure_histogram(same, "v")).n == 2


def test_price_bins_edges_and_single_price(spark):
    rows = [(f"B{i}", float(p), 10.0) for i, p in enumerate([1, 2, 3, 11, 10.99, 0])]
    df = spark.createDataFrame(rows, "asin string, price double, revenue double")
    bins = {r.bin: r.listings for r in prices.price_bins(df, "price", "revenue").collect()}
    # The 99th percentile cuts the top price; edges are 1, 2, 3 .. 11.
    assert bins == {1: 2, 2: 1, 10: 1}
    flat = spark.createDataFrame([("B1", 5.0, 1.0), ("B2", 5.0, 3.0)], df.schema)
    row = one(prices.price_bins(flat, "price", "revenue"))
    assert (row.bin, row.avg_revenue, row.price_range) == (1, 2.0, "$5.0-$6.0")


@pytest.mark.parametrize("split", [True, False])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_match_brute_force(spark, split, descending):
    rng = random.Random(11)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 12) for _ in range(300)] + [100 + i * 1e-9 for i in range(300)] + [0.0, -0.5]
    rows = [(m, v, rng.randint(1, 4)) for m in "ab" for v in values]
    df = spark.createDataFrame(rows, "market string, value double, n long")
    got = common.running_totals(df, ["n"], ["market"], descending, split=split).collect()
    for market in "ab":
        run = 0
        want = {}
        for _, v, n in sorted((r for r in rows if r[0] == market), key=lambda r: -r[1] if descending else r[1]):
            want[v] = run
            run += n
        mine = [r for r in got if r.market == market]
        assert {r.value: r.before_n for r in mine} == want and {r.all_n for r in mine} == {run}


def test_a_bin_with_a_million_real_numbers_is_cut_into_small_cells(spark):
    n = 1_000_000
    df = spark.range(n).select((1000 + F.col("id") * 1e-6).alias("x"))
    hist = common.histogram(df, F.col("x"))
    bins = hist.select(common.magnitude_bin(F.col("value")).alias("bin"), common.magnitude_cell(F.col("value")).alias("cell"))
    per_bin = [r["count"] for r in bins.groupBy("bin").count().collect()]
    per_cell = one(bins.groupBy("bin", "cell").count().agg(F.max("count").alias("most"), F.count("*").alias("cells")))
    assert max(per_bin) > 500_000 and per_cell.most < 200 and per_cell.cells > 10_000
    got = one(common.quantiles_of(hist, {"q": 0.25, "top": 1.0}, split=True))
    assert got.q == pytest.approx(1000 + (n - 1) * 0.25 * 1e-6, abs=1e-9) and got.top == 1000 + (n - 1) * 1e-6


# --- Pareto ------------------------------------------------------------------


@pytest.mark.parametrize("ties_per_group", [1, 7, 50, 100_000])
def test_pareto_splits_ties_by_the_letters_of_their_ids(spark, ties_per_group):
    rng = random.Random(3)
    ids = [f"P{i:09d}" for i in rng.sample(range(5000), 200)] + ["", "P", "Q"] + [f"X{'é' * (i % 4)}{i}" for i in range(40)]
    rows = [(a, rng.choice([0, 0, 0, 500])) for a in ids] + [(a, 700) for a in ids[:30]]
    df = spark.createDataFrame([(a, c / 100) for a, c in rows], "asin string, monthly_revenue double")
    got = [(r.asin, r.revenue, r.revenue_pct, r.product_pct) for r in pareto.pareto_curve(df, ties_per_group=ties_per_group).collect()]
    got.remove((None, None, 0.0, 0.0))
    assert sorted(got, key=lambda r: r[3]) == brute_pareto(rows)


def test_pareto_runs_nothing_while_it_is_planned(spark, tmp_path):
    group = "pareto-plan"
    spark.sparkContext.setJobGroup(group, "plan")
    try:
        df = spark.range(100).selectExpr("'B' || id AS asin", "CAST(id AS DOUBLE) AS monthly_revenue")
        curve = pareto.pareto_curve(df)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        assert curve.count() == 101
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert "ExistingRDD" not in curve._jdf.queryExecution().optimizedPlan().toString()


def test_one_absurd_price_or_revenue_stops_nothing(spark):
    rows = [("A", 1e20, 1e20), ("B", 1.0, 2.0), ("C", 2.0, 1.0), ("D", -1e20, -1e20), ("E", 1e12, 1e16)]
    df = spark.createDataFrame(rows, "asin string, price double, monthly_revenue double").withColumns(
        {"monthly_units": F.lit(1), "brand": F.col("asin"), "title": F.col("asin"), "rating": F.lit(4.0), "rating_count": F.lit(1)}
    )
    top = 2**63 / 100
    assert one(prices.price_tiers(df)).low_pct == 40.0
    bins = prices.price_bins(df, "price", "monthly_revenue").collect()
    assert sum(r.listings for r in bins) == 3 and max(r.avg_revenue for r in bins) == pytest.approx(1e16 / 1, rel=1)
    head = one(pareto.pareto_headline(df.where("asin != 'D'")))
    assert head.top_fifth_revenue_pct == pytest.approx(top / (top + 1e16 + 3) * 100) and head.products_for_80_pct == 25.0
    curve = {r.asin: r for r in pareto.pareto_curve(df.where("asin != 'D'")).collect()}
    assert curve["A"].revenue == pytest.approx(top) and curve["C"].revenue_pct == pytest.approx(100)
    assert pareto.pareto_curve(df).count() == 6
    brief = one(market_brief(df, "title"))
    assert brief.products == 5 and brief.top_brands.startswith("A(")
    shares = {r.brand: r.share_pct for r in brand.brand_revenue(df.where("asin != 'D'").unionByName(df.where("asin = 'A'"))).collect()}
    assert sum(shares.values()) == pytest.approx(100)


def test_the_brief_reads_the_listings_once(spark, tmp_path, shop):
    shop.write.parquet(str(tmp_path / "shop"))
    for by in ((), ("market",)):
        brief = market_brief(spark.read.parquet(str(tmp_path / "shop")), "title", by)
        brief.collect()
        done = brief._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert done.count("FileScan") == 1 and "ReusedExchange" in done


def brute_pareto(rows):
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    total, run, out = sum(c for _, c in rows), 0, []
    for i, (asin, c) in enumerate(rows):
        run += c
        share = run / total * 100 if total > 0 else 0.0
        out.append((asin, c / 100, share, (i + 1) / len(rows) * 100))
    return out


def test_pareto_curve_with_hot_market_ties_and_copies(spark):
    rng = random.Random(9)
    rows = [(rng.choice("aaab"), f"B{rng.randrange(150):03d}", rng.choice([0, 0, 500, rng.randrange(9000)])) for _ in range(400)]
    rows += [("a", "COPY", 700)] * 200
    df = spark.createDataFrame(
        [(m, a, c / 100) for m, a, c in rows], "market string, asin string, monthly_revenue double"
    )
    got = pareto.pareto_curve(df, ["market"]).collect()
    for market in "ab":
        want = brute_pareto([(a, c) for m, a, c in rows if m == market])
        mine = [(r.asin, r.revenue, r.revenue_pct, r.product_pct) for r in got if r.market == market]
        assert mine.count((None, None, 0.0, 0.0)) == 1
        mine = sorted((r for r in mine if r[0]), key=lambda r: r[3])
        assert mine == want
        assert mine[-1][2] == pytest.approx(100) and mine[-1][3] == 100.0
        assert all(x[2] <= y[2] for x, y in zip(mine, mine[1:], strict=False))
        head = one(pareto.pareto_headline(df.where(F.col("market") == market)))
        n = len(want)
        assert head.top_fifth_revenue_pct == want[min(int(n * 0.2), n - 1)][2]
        assert head.products_for_80_pct == next(r[3] for r in want if r[2] >= 80)


@pytest.mark.parametrize("revenues", [[0, 0, 0], [100], [-5, -5], [300, 100, -50], [1, 2, 3, 4]])
def test_pareto_small_and_odd_totals(spark, revenues):
    rows = [(f"B{i}", c) for i, c in enumerate(revenues)]
    df = spark.createDataFrame([(a, c / 100) for a, c in rows], "asin string, monthly_revenue double")
    want = brute_pareto(rows)
    got = [r for r in pareto.pareto_curve(df).collect() if r.asin]
    assert sorted((r.asin, r.revenue, r.revenue_pct, r.product_pct) for r in got) == sorted(want)
    head = one(pareto.pareto_headline(df))
    assert head.top_fifth_revenue_pct == want[min(int(len(want) * 0.2), len(want) - 1)][2]
    assert head.products_for_80_pct == next((r[3] for r in want if r[2] >= 80), 100.0)


# --- brands, KPIs, words, correlation ----------------------------------------


def test_brand_revenue_adds_up(shop):
    brands = brand.brand_revenue(shop, ["market"]).collect()
    totals = {r.market: r.total_revenue for r in kpi.market_kpis(shop, ["market"]).collect()}
    for market, total in totals.items():
        mine = [r for r in brands if r.market == market]
        assert sum(r.revenue for r in mine) == pytest.approx(total)
        assert sum(r.share_pct for r in mine) == pytest.approx(100)


@pytest.mark.parametrize(
    "fn",
    [
        kpi.market_kpis, kpi.rating_quality, kpi.new_product_stats, kpi.hot_listing_months,
        kpi.newness_revenue, kpi.top_category, prices.price_tiers, pareto.pareto_headline,
        brand.concentration, correlation.correlation_long, market_brief,
    ],
)
def test_by_market_equals_each_market_alone(shop, fn):
    def comparable(rows):
        dicts = [{k: v for k, v in r.asDict().items() if k != "market"} for r in rows]
        rounded = [
            {k: round(v, 9) if isinstance(v, float) else v for k, v in d.items()} for d in dicts
        ]
        return sorted(map(str, (sorted(d.items()) for d in rounded)))

    together = fn(shop, by=["market"]).collect()
    for market in ("a", "b", "c"):
        alone = fn(shop.where(F.col("market") == market)).collect()
        assert comparable(r for r in together if r.market == market) == comparable(alone)


def test_zero_revenue_gives_zero_shares(shop):
    free = shop.withColumn("monthly_revenue", F.lit(0.0))
    assert one(brand.concentration(free)).cr5 == 0
    assert one(kpi.new_product_stats(free)).new_share_pct == 0
    assert {r.share_pct for r in brand.top_brands(free).collect()} == {0.0}


def test_low_rating_keeps_missing_in_denominator(spark):
    df = spark.createDataFrame([(3.79, 1), (3.8, 1), (None, None), (4.0, 2)], "rating double, rating_count int")
    assert one(kpi.rating_quality(df)).low_rating_pct == 25.0
    bare = one(kpi.rating_quality(df.select(F.lit(1).alias("x"))))
    assert tuple(bare) == (0.0, 0.0, 0.0)


def test_top_category_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "category string")
    assert one(kpi.top_category(df)).category == "a"


def test_data_quality_counts_hot_and_missing_ids(spark):
    rows = [("B1", None, 1.0)] * 5 + [(None, 1.0, None)] * 3 + [("B2", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "asin string, growth double, price double")
    assert tuple(one(kpi.data_quality(df, "growth", "price"))) == (9, 6, 5, 6)


def test_brand_filter_with_list_or_table(spark, shop):
    listed = kpi.brand_filter(shop, ["x", "y"]).count()
    table = spark.createDataFrame([("x",), ("y",), ("x",)], "brand string")
    assert kpi.brand_filter(shop, table).count() == listed > 0
    assert kpi.brand_filter(shop).count() == shop.count()


def test_keywords_match_python(shop):
    from collections import Counter

    from shelfsight.config import KEYWORD_STOP_WORDS

    titles = [r.title for r in shop.select("title").collect()]
    words = [
        w for w in " ".join(titles).split()
        if w not in KEYWORD_STOP_WORDS and not w.isdigit() and len(w) > 2
    ]
    got = {r.word: r.frequency for r in keywords.keyword_counts(shop).collect()}
    assert got == dict(Counter(words))


def test_correlation_matches_pandas(shop):
    names = list(correlation.METRICS)
    want = shop.select(*names).toPandas().astype(float).corr().fillna(0)
    got = {(r.x, r.y): r.r for r in correlation.correlation_long(shop).collect()}
    assert len(got) == 36
    for (x, y), r in got.items():
        assert r == pytest.approx(want.loc[x, y], abs=1e-9)


def test_correlation_leaves_out_constant_columns(shop):
    flat = shop.withColumn("price", F.lit(3.0))
    assert "price" not in {r.x for r in correlation.correlation_long(flat).collect()}
    only = shop.select(F.lit(1.0).alias("price"), "monthly_units")
    assert correlation.correlation_long(only).count() == 0


# --- attributes, parents, sizes ----------------------------------------------


def test_attribute_kind_and_rounding(spark):
    rows = [("2.5", "B1"), ("2", "B2"), ("x", "B3"), ("0.4", "B4"), (None, "B5"), ("3.5", "B6")]
    df = spark.createDataFrame(rows, "size string, asin string").withColumns(
        {"monthly_units": F.lit(1), "monthly_revenue": F.lit(2.0), "price": F.lit(3.0)}
    )
    assert attributes.is_numeric_attribute(df, "size")
    got = [(r.attr, r.listings) for r in attributes.top_attributes(df, "size").collect()]
    assert got == [(2.0, 2), (4.0, 1)]
    texts = df.where(F.col("size") == "x")
    assert not attributes.is_numeric_attribute(texts, "size")
    assert attributes.top_attributes(texts, "size").collect()[0].attr == "x"


def test_parents(spark):
    rows = [("B1", "P", 1), ("B2", "P", 2), ("B3", None, 3)]
    df = spark.createDataFrame(rows, "asin string, parent_asin string, monthly_units int")
    stats = parents.parent_stats(parents.with_parent(df))
    assert {(r.parent_id, r.variants, r.units) for r in stats.collect()} == {("P", 2, 3), ("独立产品", 1, 3)}
    assert tuple(one(parents.parent_kpis(stats))) == (2, 1, 1.5)
    made = df.select("asin", F.lit("The New Red Cup").alias("title"), F.lit(12.0).alias("price"))
    assert parents.with_parent(made).select("parent_id").distinct().collect()[0][0] == "Unknown | red cup | 10-25"


def test_sizes(spark):
    rows = [
        ("B1", "91.45", "10", "1", "2K+ bought", "$5.00"),
        ("B2", "12", "63.6", "64", "300", "x"),
        ("B3", "12", "1", None, "300", "$1"),
        ("B4", "1000", "1", "1", "junk", "$1"),
    ]
    df = spark.createDataFrame(
        rows, "asin string, pkg_l string, pkg_w string, pkg_h string, sales_text string, price_curr string"
    )
    sized = sizes.sized(df)
    assert sorted(r.asin for r in sized.collect()) == ["B1", "B2"]
    assert tuple(one(sizes.size_compliance(sized)))[:4] == (2, 1, 1, 1)
    bands = {r.size_band: (r.listings, r.revenue, r.share_pct) for r in sizes.size_bands(sized).collect()}
    assert bands == {"60-100cm": (2, 10000.0, 100.0)}
    assert {(r.length_bin, r.label) for r in sizes.length_bins(sized).collect()} == {(90, "90-95cm"), (10, "10-15cm")}
    assert one(sizes.leader_bound(sizes.size_leaders(sized))).max_units == 2000
    assert one(sizes.leader_bound(sizes.size_leaders(sized.limit(0)))).max_units == 100


# --- score -------------------------------------------------------------------

SCORE_SCHEMA = (
    "asin string, sales_text string, rank_drops double, price_curr double, rating_count double, "
    "rating_val double, oos_90 double, share_amz_90 string, offers_fba double, offers_fbm double"
)


# Inputs with the score and tags worked out by hand for the default settings.
BY_HAND = [
    # Demand: units first, rank drops only without units.
    (dict(sales_text="150"), 15, ""),
    (dict(sales_text="1001"), 30, "🔥月销1k+"),
    (dict(sales_text="0", rank_drops=15.0), 12, ""),
    (dict(rank_drops=30.0), 24, ""),
    (dict(rank_drops=61.0), 30, "📉高频出单"),
    (dict(sales_text="3", rank_drops=61.0), 0, ""),
    # Price: inside the range with both ends, then 3 points for each unit outside.
    (dict(price_curr=15.0), 20, ""),
    (dict(price_curr=80.0), 20, ""),
    (dict(price_curr=5.0), 14, "⚠️低价"),
    (dict(price_curr=10.0), 17, ""),
    (dict(price_curr=90.0), 14, ""),
    (dict(price_curr=300.0), 0, ""),
    (dict(price_curr=0.0), 0, ""),
    # Reviews, and the seller's share.
    (dict(rating_count=0.0), 25, "✨新星"),
    (dict(rating_count=50.0), 21, ""),
    (dict(rating_count=100.0), 18, ""),
    (dict(rating_count=200.0), 0, ""),
    (dict(rating_count=100.0, share_amz_90="50%"), 18, ""),
    (dict(rating_count=100.0, share_amz_90="51%"), 9, "🦖AMZ垄断"),
    (dict(rating_count=100.0, share_amz_90="80%"), 9, "🦖AMZ垄断"),
    (dict(rating_count=100.0, share_amz_90="81%"), 1, "🦖AMZ垄断"),
    # Sellers: both counts are needed.
    (dict(offers_fba=4.0, offers_fbm=0.0), 0, "👥卖家少"),
    (dict(offers_fba=4.0, offers_fbm=1.0), 0, ""),
    (dict(offers_fba=0.0, offers_fbm=0.0), 0, ""),
    (dict(offers_fba=4.0), 0, ""),
    # Growth: out of stock, and products to improve.
    (dict(oos_90=15.0), 0, ""),
    (dict(oos_90=16.7), 10, "🚨缺货16%"),
    (dict(sales_text="150", rating_val=3.0), 15, ""),
    (dict(sales_text="151", rating_val=3.0), 30, "🛠️改良机会"),
    (dict(rank_drops=46.0, rating_val=3.9), 45, "🛠️改良机会"),
    (dict(rank_drops=46.0, rating_val=4.0), 30, ""),
    (dict(rank_drops=46.0, rating_val=2.9), 30, ""),
    (dict(sales_text="151", rating_val=3.5, oos_90=20.0), 40, "🚨缺货20% 🛠️改良机会"),
    # Three tags at most, in this order; nothing known gives 0.
    (
        dict(sales_text="2000", price_curr=5.0, rating_count=10.0, share_amz_90="90%"),
        46, "🔥月销1k+ ⚠️低价 ✨新星",
    ),
    ({}, 0, ""),
]


def _scored(spark, config):
    names = [c.split()[0] for c in SCORE_SCHEMA.split(", ")][1:]
    rows = [(f"B{i}", *[given.get(n) for n in names]) for i, (given, *_) in enumerate(BY_HAND)]
    scored = score.opportunity_score(spark.createDataFrame(rows, SCORE_SCHEMA), config)
    return {r.asin: (r.score, r.tags) for r in scored.collect()}


def test_scores_by_hand(spark):
    got = _scored(spark, ScoreConfig())
    assert got == {f"B{i}": (points, tags) for i, (_, points, tags) in enumerate(BY_HAND)}


@pytest.mark.parametrize("config", [APP_SCORE, ScoreConfig(0, 0, 0, 0)])
def test_scores_under_other_settings(spark, config):
    got = _scored(spark, config)
    assert all(0 <= points <= 100 for points, _ in got.values())
    # 35 of 100 points for units in the app, none without weights.
    assert got["B1"][0] == (35 if config is APP_SCORE else 0)


def test_attribute_kinds_are_each_markets_own(spark):
    rows = [
        ("m1", "A1", "Red", 10.0), ("m1", "A2", "Blue", 20.0), ("m2", "A3", "5", 30.0), ("m2", "A4", "4.6", 40.0),
        ("m2", "A5", "none", 50.0), ("m2", "A6", "-3", 60.0), (None, "A7", "Green", 70.0), ("m3", "A8", "-1", 80.0),
    ]
    df = spark.createDataFrame(rows, "market string, asin string, size string, price double").withColumns(
        {"monthly_units": F.lit(1), "monthly_revenue": F.col("price")}
    )
    got = {(r.market, r.attr, r.listings) for r in attributes.top_attributes(df, "size", by=["market"]).collect()}
    assert got == {("m1", "Red", 1), ("m1", "Blue", 1), ("m2", "5", 2), (None, "Green", 1)}
    box = {(r.market, r.attr, r.low, r.high) for r in attributes.attribute_price_box(df.where("market is not null"), "size", by=["market"]).collect()}
    assert box == {("m1", "Red", 10, 10), ("m1", "Blue", 20, 20), ("m2", "5", 30, 40)}
    lone = attributes.top_attributes(df, "size", by=["market"], most_texts=1, most_numeric=1).collect()
    assert sorted((r.market or "", r.attr) for r in lone) == [("", "Green"), ("m1", "Blue"), ("m2", "5")]


def test_large_values_stay_in_a_mean(spark):
    from shelfsight.operators.common import rounded_avg

    df = spark.createDataFrame([(2e12,), (4.0,)], "x double")
    assert one(df.select(rounded_avg(F.col("x"), 2).alias("m"))).m == 1000000000002.0


def test_absent_and_missing_reviews_differ(spark):
    df = spark.createDataFrame([("B1", None)], "asin string, rating_count double")
    assert one(score.opportunity_score(df)).score == 0
    assert one(score.opportunity_score(df.select("asin"))).score == 25
    mapped = score.opportunity_score(df.toDF("asin", "reviews"), columns={"rating_count": "reviews"})
    assert one(mapped).score == 0


def test_score_settings():
    assert APP_SCORE.weight_shares() == {"w_sales": 35, "w_profit": 20, "w_comp": 25, "w_growth": 20}
    assert set(ScoreConfig(0, 0, 0, 0).weight_shares().values()) == {0}
    with pytest.raises(ValueError, match="positive"):
        ScoreConfig(target_sales=0)


# --- every operator on no rows and on one row ---------------------------------

PER_MARKET = {
    "market_kpis": kpi.market_kpis,
    "top_category": kpi.top_category,
    "newness_revenue": kpi.newness_revenue,
    "new_product_stats": kpi.new_product_stats,
    "hot_listing_months": kpi.hot_listing_months,
    "rating_quality": kpi.rating_quality,
    "brand_revenue": brand.brand_revenue,
    "top_brands": lambda df, by=(): brand.top_brands(df, by=by),
    "concentration": lambda df, by=(): brand.concentration(df, by=by),
    "price_tiers": prices.price_tiers,
    "price_bins": lambda df, by=(): prices.price_bins(df, "price", "monthly_revenue", by),
    "attributes": lambda df, by=(): attributes.top_attributes(df, "title", by=by),
    "attribute_box": lambda df, by=(): attributes.attribute_price_box(df, "title", by=by),
    "keywords": lambda df, by=(): keywords.top_keywords(df, by=by),
    "correlation": lambda df, by=(): correlation.correlation_long(df, by=by),
    "pareto_curve": pareto.pareto_curve,
    "pareto_headline": pareto.pareto_headline,
    "top_listings": lambda df, by=(): listings.top_listings(df, by=by),
    "growth_leaders": lambda df, by=(): listings.growth_leaders(df, by=by),
    "growth_matrix": listings.growth_matrix,
    "parents": lambda df, by=(): parents.parent_stats(parents.with_parent(df), by),
    "brief": lambda df, by=(): market_brief(df, "title", by),
}


@pytest.mark.parametrize("name", list(PER_MARKET))
def test_no_rows_and_one_row(empty, shop, name):
    fn = PER_MARKET[name]
    fn(empty).collect()
    assert fn(empty, by=["market"]).count() == (0)
    single = shop.limit(1)
    fn(single).collect()
    fn(single, by=["market"]).collect()


def test_all_null_columns(spark, shop):
    nulls = shop.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in shop.schema])
    for fn in PER_MARKET.values():
        fn(nulls.limit(3)).collect()


def test_dashboard(shop):
    shared, charts = listing_dashboard(shop, "title")
    assert shared.is_cached
    assert {"market_kpis", "attribute", "fulfillment_share", "pareto"} <= set(charts)
    assert charts["market_kpis"].collect()[0].products == shop.count()
    shared.unpersist()


def test_absurd_prices_neither_overflow_nor_vanish(spark):
    from shelfsight.operators.common import money_avg, money_sum

    rows = [(1e20,), (1e20,), (1.0,), (None,)]
    got = one(spark.createDataFrame(rows, "p double").agg(money_sum(F.col("p")).alias("s"), money_avg(F.col("p")).alias("m")))
    # A row counts for at most 2^63 cents.
    assert got.s == pytest.approx(2 * 2**63 / 100) and got.m == pytest.approx(got.s / 3)
    small = spark.createDataFrame([(1e12,), (0.01,)], "p double")
    assert one(small.agg(money_sum(F.col("p")).alias("s"))).s == 1000000000000.01


def test_copies_of_a_row_are_written_by_several_tasks(spark):
    n = 5 * pareto.COPIES_PER_ARRAY
    df = spark.range(n).select(F.lit(None).cast("string").alias("asin"), F.lit(0.0).alias("monthly_revenue"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        curve = pareto.pareto_curve(df).withColumn("task", F.spark_partition_id())
        per_task = [r["count"] for r in curve.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(per_task) == n + 1 and max(per_task) < n


def test_size_extent_reads_the_parcels_once(spark):
    df = spark.createDataFrame([("a", 10.0, 200.0), ("b", 300.0, 20.0)], "asin string, pkg_l double, pkg_w double")
    extent = sizes.size_extent(df)
    got = one(extent)
    assert (got.max_length, got.max_width) == (pytest.approx(297.1 * 1.1), pytest.approx(198.2 * 1.1))
