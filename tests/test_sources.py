from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfsight.operators.clean import clean_history, clean_listings
from shelfsight.sources import files, headers

TEXT = 'ASIN, 商品标题 ,价格($),品牌\nB1,红色瓶子,$9.99,牌\nB2,"a ""b"", c",N/A,\n'


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_charsets_give_equal_frames(spark, tmp_path):
    want = [("B1", "红色瓶子", "$9.99", "牌"), ("B2", 'a "b", c', None, None)]
    for encoding in ("utf-8", "utf-8-sig", "gbk", "gb18030"):
        path = write(tmp_path / f"{encoding}.csv", TEXT, encoding)
        df = files.read_exports(spark, path)
        assert df.columns == ["ASIN", "商品标题", "价格($)", "品牌"], encoding
        assert rows(df) == want, encoding


def test_mixed_files_union_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", "ASIN,品牌\nB1,牌\n")
    write(tmp_path / "b.csv", "品牌,ASIN\n子,B2\n", "gbk")
    write(tmp_path / "c.csv", "ASIN,品牌,x\nB3,丙,1\n")
    write(tmp_path / "d.csv", 'ASIN,品牌\nB4,"two\nlines"\n')
    df = files.read_exports(spark, str(tmp_path))
    got = {r["ASIN"]: r["品牌"] for r in df.collect()}
    assert got == {"B1": "牌", "B2": "子", "B3": "丙", "B4": "two\nlines"}


def test_odd_file_names(spark, tmp_path):
    for i, name in enumerate(["a b", "列表", "p%20q+r", "x[1]{2}"]):
        write(tmp_path / f"{name}.csv", f"ASIN\nB{i}\n")
    assert rows(files.read_exports(spark, str(tmp_path))) == [("B0",), ("B1",), ("B2",), ("B3",)]


def test_headers_that_differ_in_case(spark, tmp_path):
    df = files.read_csv(spark, write(tmp_path / "a.csv", "ASIN,asin\n1,2\n"))
    assert df.columns == ["ASIN", "asin.1"]
    assert rows(df) == [("1", "2")]


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("m1", "B1", 2), ("m2", "B2", 3)], "market string, asin string, n int")
    files.write_table(df, str(tmp_path / "p"), "parquet", by=["market"])
    assert rows(spark.read.parquet(str(tmp_path / "p")).select(*df.columns)) == rows(df)
    files.write_table(df, str(tmp_path / "c"), "csv")
    assert rows(files.read_csv(spark, str(tmp_path / "c"))) == [("m1", "B1", "2"), ("m2", "B2", "3")]


def test_header_resolution():
    columns = [
        "ASIN", "Parent ASIN", "Title", "Sales Rank: Drops last 90 days",
        "Sales Rank: Drops last 90 days %", "Sales Rank: 90 days avg.",
        "Buy Box: Current", "Count of retrieved live offers: New, FBA",
        "Reviews: Rating", "Reviews: Rating Count", "Image URLs",
    ]
    got = headers.resolve_headers(columns)
    assert got["asin"] == "ASIN"
    assert got["parent_asin"] == "Parent ASIN"
    assert got["rank_drops"] == "Sales Rank: Drops last 90 days"
    assert got["rank_avg_90"] == "Sales Rank: 90 days avg."
    assert got["price_curr"] == "Buy Box: Current"
    assert got["rating_val"] == "Reviews: Rating"
    assert got["rating_count"] == "Reviews: Rating Count"
    assert got["image"] == "Image URLs"
    assert "oos_90" not in got


def test_longest_headers_do_not_match():
    assert "title" not in headers.resolve_headers(["Title" + "x" * 120])


def test_attribute_and_column_lists(spark):
    columns = ["参数_重", "参数_Z", "Color", "x", "Item: Length (cm)", "材质说明"]
    assert headers.attribute_candidates(columns) == sorted(set(columns) - {"x"})
    df = spark.createDataFrame([("a", "b")], "Name string, `标题` string")
    assert headers.existing(df, ["title", "标题", "Name"]) == ["标题", "Name"]
    first = headers.first_existing(df, ["title", "标题"], F.lit("none"))
    assert df.select(first).collect()[0][0] == "b"
    default = headers.first_existing(df, ["title"], F.lit("none"))
    assert df.select(default).collect()[0][0] == "none"


def test_clean_history_by_resolved_names(spark):
    columns = ["ASIN", "Sales Rank: 90 days avg.", "Buy Box 🚚: Current", "Reviews: Rating Count"]
    df = spark.createDataFrame(
        [("B1", "12,000.5", "$12.99", "x"), ("B2", None, None, "7%")], columns
    )
    got = clean_history(df).orderBy("asin").collect()
    assert [r.rank_avg_90 for r in got] == [12000.5, None]
    assert [r.price_curr for r in got] == [12.99, None]
    assert [r.price_curr_raw for r in got] == ["$12.99", None]
    assert [r.rating_count for r in got] == [None, 7.0]


@pytest.mark.parametrize("absent", list(headers.LISTING_HEADERS.values()))
def test_each_listing_column_may_be_absent(spark, absent):
    full = {name: "1" for name in headers.LISTING_HEADERS.values()}
    full.pop(absent)
    df = spark.createDataFrame([tuple(full.values())], list(full))
    cleaned = clean_listings(df, as_of="2024-01-01")
    assert cleaned.count() == 1
    if absent in ("brand", "category"):
        assert cleaned.select(absent).collect()[0][0] == "Unknown"


def test_headers_stay_as_written(spark, tmp_path):
    text = "ASIN,Feature 1,Feature 2,Rank 1,x,x,X, y ,,Feature 1\n1,2,3,4,5,6,7,8,9,10\n"
    df = files.read_csv(spark, write(tmp_path / "a.csv", text))
    assert df.columns == ["ASIN", "Feature 1", "Feature 2", "Rank 1", "x", "x.1", "X.2", "y", "Unnamed: 8", "Feature 1.1"]
    assert rows(df) == [tuple(str(i) for i in range(1, 11))]
    assert rows(files.read_exports(spark, str(tmp_path / "a.csv"))) == rows(df)
    history = headers.resolve_headers(["Description & Features: Feature 1", "Description & Features: Feature 2"])
    assert history["feat1"].endswith("1") and history["feat2"].endswith("2")


def test_an_inch_mark_does_not_make_a_file_one_task(spark, tmp_path):
    text = 'ASIN,品牌\nB1,5" pipe\nB2,"a ""b"" c"\nB3,"x, ""y"""\nB4,""\n'
    path = write(tmp_path / "a.csv", text)
    ((_, multi_line, _),) = files.file_kinds(spark, path)
    assert not multi_line
    assert rows(files.read_exports(spark, path)) == [("B1", '5" pipe'), ("B2", 'a "b" c'), ("B3", 'x, "y"'), ("B4", None)]
    ((_, multi_line, _),) = files.file_kinds(spark, write(tmp_path / "b.csv", 'ASIN,品牌\nB1,"5"" two\nlines"\n'))
    assert multi_line


def test_uniform_exports_of_both_charsets_are_read_once(spark, tmp_path):
    from pyspark.sql import Observation

    want = [("B1", "红色瓶子", "$9.99", "牌"), ("B2", 'a "b", c', None, None)]
    for encoding in ("utf-8", "utf-8-sig", "gbk", "gb18030"):
        write(tmp_path / f"{encoding}.csv", TEXT, encoding)
    seen = Observation()
    df = files.read_uniform_exports(spark, str(tmp_path), observation=seen)
    assert df.columns == ["ASIN", "商品标题", "价格($)", "品牌"]
    assert rows(df) == sorted(want * 4, key=str)
    # Rows of ASCII alone count as UTF-8.
    assert seen.get == {"rows": 12, "gb18030": 4, "headers": 4, "broken": 0}
    text = df._jdf.queryExecution().sparkPlan().toString()
    assert text.count("FileScan csv") == 1 and "Exchange" not in text


def test_uniform_exports_stop_at_what_they_cannot_tell(spark, tmp_path):
    write(tmp_path / "a.csv", "ASIN,品牌,n\nB1,牌,1\n")
    write(tmp_path / "b.csv", "品牌,ASIN,n\n子,B2,2\n", "gbk")
    with pytest.raises(Exception, match="another header"):
        files.read_uniform_exports(spark, str(tmp_path)).collect()
    broken = write(tmp_path / "c.csv", 'ASIN,品牌,n\nB1,"two\nlines",3\n')
    with pytest.raises(Exception, match="as many cells"):
        files.read_uniform_exports(spark, broken).collect()
    assert rows(files.read_uniform_exports(spark, broken, multi_line=True)) == [("B1", "two\nlines", "3")]
    short = write(tmp_path / "d.csv", "ASIN,品牌,n\nB1\nB2,牌,1\n")
    assert rows(files.read_uniform_exports(spark, short, strict=False)) == [("B1", None, None), ("B2", "牌", "1")]
    (tmp_path / "e.csv").write_bytes(b"ASIN,n\n\xff\xff,1\n")
    with pytest.raises(Exception):
        files.read_uniform_exports(spark, str(tmp_path / "e.csv")).collect()


def test_files_follow_the_bytes_of_their_market(spark, tmp_path):
    df = spark.range(40_000).selectExpr("IF(id % 100 = 0, concat('m', id % 7), 'hot') AS market", "sha2(CAST(id AS STRING), 256) AS asin", "id AS n")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files.write_table(df.repartition(16), str(tmp_path / "p"), by=["market"], file_size="500k")
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
    per_market = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "p").iterdir() if p.is_dir()}
    assert 3 <= per_market.pop("market=hot") <= 14
    # A small market may share the hot one's shuffle partition.
    assert list(per_market.values()).count(1) >= 5 and len(per_market) == 7
    assert spark.read.parquet(str(tmp_path / "p")).count() == 40_000


def test_csv_with_a_utf8_mark(spark, tmp_path):
    df = spark.createDataFrame([("m1", "B1", "瓶"), ("m2", "B2", "x")], "market string, asin string, t string")
    files.write_table(df, str(tmp_path / "c"), "csv", by=["market"], utf8_mark=True)
    written = list((tmp_path / "c").glob("*/*.csv"))
    assert len(written) == 2 and all(p.read_bytes().startswith(b"\xef\xbb\xbfasin,t\n") for p in written)
    back = files.read_csv(spark, [str(p) for p in written])
    assert back.columns == ["asin", "t"] and rows(back) == [("B1", "瓶"), ("B2", "x")]
