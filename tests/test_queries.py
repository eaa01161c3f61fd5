from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from shelfsight.queries import all_queries, all_twins
from twins import connect, differences

SMALL = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.abspath(entry.__file__))
# The operators for training data have tests, and twins, of their own.
QUERIES = all_queries()
TWINS = all_twins()

pytestmark = pytest.mark.skipif(
    not os.path.isdir(SMALL), reason="the trade tables are not here"
)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("empty_folder", [True, False])
def test_everything_else_stands_without_the_training_data_operators(tmp_path, pipeline, empty_folder):
    left_out = shutil.ignore_patterns("llm", "__pycache__", ".git", *([] if pipeline else ["corpus_pipeline.py"]))
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=left_out)
    if empty_folder:
        (copy / "shelfsight" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True)
    names, twins = run.stdout.splitlines()
    assert names.split() == sorted(QUERIES) and twins.split() == sorted(TWINS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_twin_and_plan(spark, con, name):
    assert differences(spark, con, QUERIES[name], TWINS[name], SMALL) == []
    text = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "NestedLoopJoin"):
        assert node not in text


@pytest.mark.parametrize("name", ["opportunity_top50", "brand_revenue_top10", "top3_listings", "title_keywords"])
def test_top_k_is_not_a_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SMALL))


def test_top_k_per_market_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["top3_listings_by_category"](spark, SMALL))


@pytest.mark.parametrize("name", ["line_price_quartiles", "brand_revenue_top10", "price_tiers", "concentration"])
def test_branches_share_one_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    final = text[: text.find("== Initial Plan ==")] if name == "line_price_quartiles" else text
    assert "ReusedExchange" in final


def test_scans_read_only_used_columns(spark):
    text = plan(QUERIES["brand_list"](spark, SMALL))
    assert "p_retailprice" not in text
    assert "lineitem" not in text or "l_extendedprice" not in text
