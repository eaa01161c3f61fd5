"""From export files to the brief, the merge and the score."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shelfsight.config import APP_SCORE
from shelfsight.operators.clean import clean_history, clean_listings
from shelfsight.operators.kpi import market_kpis
from shelfsight.operators.merge import merge_history
from shelfsight.operators.score import opportunity_score, top_opportunities
from shelfsight.plans.brief import market_brief
from shelfsight.queries import tables
from shelfsight.sources.files import read_exports
from shelfsight.sources.headers import canonical_listings

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(
    not os.path.isdir(SMALL), reason="the trade tables are not here"
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")

    def write(df, name, encoding):
        writer = df.write.option("header", True).option("encoding", encoding)
        writer.option("escape", '"').csv(str(root / name))

    export = tables.listing_export(spark, SMALL)
    even = F.substring(F.trim("ASIN"), 2, 12).cast("bigint") % 2 == 0
    write(export.where(even).repartition(2), "listings/utf8", "UTF-8")
    write(export.where(~even).repartition(2), "listings/gbk", "GBK")
    write(tables.history_export(spark, SMALL).repartition(2), "history", "UTF-8")
    return root


def test_files_give_the_same_table_as_the_source(spark, folder):
    read = read_exports(spark, [str(folder / "listings/utf8"), str(folder / "listings/gbk")])
    from_files = clean_listings(canonical_listings(read), tables.AS_OF)
    direct = clean_listings(
        canonical_listings(tables.listing_export(spark, SMALL)), tables.AS_OF
    )
    # The writer drops the blanks around ids; everything else is equal.
    direct = direct.withColumn("asin", F.trim("asin"))
    from_files = from_files.withColumn("asin", F.trim("asin"))
    columns = sorted(direct.columns)
    assert sorted(from_files.columns) == columns
    assert from_files.select(columns).exceptAll(direct.select(columns)).isEmpty()
    assert direct.select(columns).exceptAll(from_files.select(columns)).isEmpty()


def test_brief_merge_and_score_from_files(spark, folder):
    listings = clean_listings(
        canonical_listings(
            read_exports(spark, [str(folder / "listings/utf8"), str(folder / "listings/gbk")])
        ),
        tables.AS_OF,
    )
    history = clean_history(read_exports(spark, str(folder / "history")))
    n = market_kpis(listings).collect()[0].products
    brief = market_brief(listings, "brand").collect()
    assert len(brief) == 1 and brief[0].products == n
    merged = merge_history(listings, history)
    assert merged.count() == n
    assert merged.where(F.col("rank_curr").isNull()).count() == 0
    scored = opportunity_score(merged, APP_SCORE, {"rating_count": "rating_count_history"})
    best = top_opportunities(scored).collect()
    assert 0 < len(best) <= 50
    assert [r.score for r in best] == sorted((r.score for r in best), reverse=True)
    alone = opportunity_score(history, APP_SCORE)
    assert (
        scored.agg(F.sum("score")).collect()[0][0] == alone.agg(F.sum("score")).collect()[0][0]
    )
