"""Results are found again by what they were made from."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from shelfsight.operators.kpi import market_kpis
from shelfsight.plans.dashboard import (
    history_charts,
    history_dashboard,
    listing_charts,
    stored_dashboard,
)
from shelfsight.plans.store import ResultStore
from shelfsight.sources.files import read_csv


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text(f"asin,n\nB{i},{i}\n")
    return folder


def test_a_second_call_reads_no_source_file_and_a_changed_file_does(spark, tmp_path, files):
    store = ResultStore(spark, str(tmp_path / "store"))
    calls = []

    def build():
        calls.append(1)
        return read_csv(spark, str(files))

    def ask(**params):
        return store.result("rows", build, str(files), **params)

    first = sorted(ask(market="a").collect())
    again = ask(market="a")
    assert len(calls) == 1 and sorted(again.collect()) == first and len(first) == 3
    assert all("/store/results/rows/" in f for f in again.inputFiles())
    # Another session finds it too; another parameter or version does not.
    assert ResultStore(spark, str(tmp_path / "store")).result("rows", build, str(files), market="a").count() == 3
    assert len(calls) == 1
    ask(market="b")
    ResultStore(spark, str(tmp_path / "store"), version="2").result("rows", build, str(files), market="a")
    assert len(calls) == 3
    # Same size, other time; then other size; then one file more.
    (files / "1.csv").write_text("asin,n\nB9,9\n")
    os.utime(files / "1.csv", (time.time() + 5, time.time() + 5))
    assert "B9" in {r.asin for r in ask(market="a").collect()}
    (files / "1.csv").write_text("asin,n\nB99,9\n")
    assert "B99" in {r.asin for r in ask(market="a").collect()}
    (files / "3.csv").write_text("asin,n\nB3,3\n")
    assert ask(market="a").count() == 4
    assert len(calls) == 6


def test_a_result_that_broke_off_or_went_is_made_again(spark, tmp_path, files):
    import shutil

    store = ResultStore(spark, str(tmp_path / "store"))
    broken = lambda: spark.range(5).select(F.raise_error(F.lit("lost")).cast("int").alias("x"))
    with pytest.raises(Exception, match="lost"):
        store.result("x", broken, str(files)).collect()
    assert store.find("x", store.key("x", str(files), {})) is None
    assert store.result("x", lambda: spark.range(3), str(files)).count() == 3
    shutil.rmtree(tmp_path / "store" / "results")
    assert store.result("x", lambda: spark.range(4), str(files)).count() == 4


@pytest.fixture
def merged(spark):
    """Merged listings and history."""
    return spark.range(60).selectExpr(
        "'B' || id AS asin", "'brand' || id % 5 AS brand", "'Steel bottle ' || id % 7 AS title",
        "'P' || id % 9 AS parent_asin", "CAST(id AS DOUBLE) AS price", "id AS monthly_units",
        "CAST(id * 10 AS DOUBLE) AS monthly_revenue", "CAST(id % 40 AS DOUBLE) AS oos_90",
        "CAST(id AS DOUBLE) AS rank_curr", "CAST(id % 90 AS DOUBLE) AS rank_drops",
        "CASE WHEN id % 4 > 0 THEN '$' || id || '.50' ELSE 'n/a' END AS price_curr_raw",
        "id || '+ bought' AS sales_text", "CASE WHEN id % 2 = 0 THEN 'x' END AS fbt",
        "CAST(id AS DOUBLE) AS pkg_l", "CAST(id AS DOUBLE) AS pkg_w", "CAST(id AS DOUBLE) AS pkg_h",
        "CASE WHEN id < 40 THEN 'us' ELSE 'de' END AS market",
    )


@pytest.mark.parametrize("by", [(), ("market",)])
def test_history_dashboard(merged, by):
    shared, charts = history_dashboard(merged, by=by)
    assert shared.is_cached
    for name, chart in charts.items():
        assert chart.count() > 0, name
    assert charts["out_of_stock"].count() == 58
    assert {r.filled for r in charts["fbt_coverage"].collect()} == ({30} if not by else {20, 10})
    assert charts["parent_kpis"].agg(F.sum("parents")).first()[0] == (9 if not by else 18)
    assert "brand" in charts["size_leaders"].columns and "parent_asin" in charts["size_leaders"].columns
    shared.unpersist()


def test_a_chart_without_its_columns_is_left_out(merged):
    charts = history_charts(merged.drop("fbt", "pkg_l", "rank_curr", "monthly_revenue", "price_curr_raw"))
    assert not {"fbt_coverage", "size_bands", "out_of_stock", "price_bins", "unreadable_prices"} & set(charts)


def test_stored_dashboard(spark, tmp_path, files, merged):
    store, calls = ResultStore(spark, str(tmp_path / "store")), []

    def load():
        calls.append(1)
        return merged

    def few(shared, by=()):
        return {k: v for k, v in listing_charts(shared, by=by).items() if k in ("market_kpis", "top_brands")}

    def ask(**params):
        return stored_dashboard(store, load, few, str(files), **params)

    first, second = ask(), ask()
    assert len(calls) == 1 and set(first) == set(second) == {"market_kpis", "top_brands"}
    assert second["market_kpis"].collect() == market_kpis(merged).collect()
    assert ask(by=["market"])["market_kpis"].count() == 2 and len(calls) == 2
    assert all("/store/results/" in f for f in second["top_brands"].inputFiles())
