"""CSV in, CSV or Parquet out."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfsight.operators.common import with_once
from shelfsight.sources.headers import unique_headers

# Spellings of a missing value; Spark's nullValue option takes only one.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def blank_to_null(df: DataFrame) -> DataFrame:
    """NULL for every spelling of a missing value in the text columns."""
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns(
        {
            name: F.when(~F.col(f"`{name}`").isin(*MISSING_TOKENS), F.col(f"`{name}`"))
            for name in text
        }
    )


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Column names as the header row has them; only nameless ones and repeats are changed."""
    named = [f"Unnamed: {i}" if c is None else c.lstrip("\ufeff") for i, c in enumerate(cells)]
    return unique_headers([name.strip() for name in named])


def header_row(spark: SparkSession, paths: Sequence[str], options: dict[str, object]) -> list[str | None]:
    """The cells of the first row of one of the files, however they are named; a read of its first lines."""
    first = spark.read.options(**options).option("header", False).csv(list(paths)).head()
    return list(first) if first is not None else []


def by_position(width: int) -> StructType:
    """Columns of text by number, which no header can change."""
    return StructType([StructField(f"c{i}", StringType()) for i in range(width)])


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> DataFrame:
    """All columns as text under trimmed headers; no inference pass.

    The header row is read by itself and columns are bound by their place, so
    headers stay as written; repeated ones, also those that differ in case
    alone, are numbered ``.1``, ``.2``. ``multi_line`` is for files whose quoted
    cells hold line breaks. Such a file is one task, so leave it off where it is
    not needed.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = {"encoding": encoding, "escape": '"', "multiLine": multi_line}
    names = header_names(header_row(spark, paths, options))
    raw = spark.read.options(**options).option("header", True).schema(by_position(len(names))).csv(paths)
    return blank_to_null(raw.toDF(*names))


def read_uniform_exports(
    spark: SparkSession,
    paths: str | Sequence[str],
    multi_line: bool = False,
    strict: bool = True,
    observation: Observation | None = None,
) -> DataFrame:
    """Exports that share one header, in either charset, read in one pass.

    Bytes come in as they are and each row finds its charset: UTF-8 if all its
    cells are valid in it, else GB18030, which also reads GBK. A row that is
    neither stops the job. So do, unless ``strict`` is off, a row with more
    or fewer cells than the header, which a line break inside quotes without
    ``multi_line`` makes of one, and the header of a file that has another one.
    Quotes inside a cell do no harm.

    ``observation`` gets, with the first action, how many rows there were, how
    many were in GB18030, how many were headers and how many were ``broken``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = {"encoding": "ISO-8859-1", "escape": '"', "multiLine": multi_line}
    head = header_row(spark, paths, options)
    # One byte became one letter.
    decoded = spark.range(1).select(F.array(*[F.lit(c).cast("string") for c in head]).alias("head"))
    decoded = decoded.select(F.transform("head", lambda c: _text(c, _is_utf8(F.array_join("head", ","))))).first()[0]
    names = header_names(decoded)
    schema = by_position(len(names)).add("_broken", "string")
    raw = (
        spark.read.options(**options)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_broken")
        .schema(schema)
        .csv(paths)
    )
    cells = [F.col(f"c{i}") for i in range(len(names))]
    utf8 = _is_utf8(F.concat_ws(",", *cells))
    rows = with_once(raw, {"_utf8": utf8})
    texts = {f"c{i}": F.ltrim(_text(c, F.col("_utf8")), F.lit("\ufeff")) if i == 0 else _text(c, F.col("_utf8")) for i, c in enumerate(cells)}
    rows = rows.withColumns(texts)
    written = [None if c is None else c.lstrip("\ufeff") for c in decoded]
    same = reduce(and_, [c.eqNullSafe(F.lit(w)) for c, w in zip(cells, written, strict=True)], F.lit(True))
    known = F.array(*[F.lit(w) for w in written if w is not None]).cast("array<string>")
    alike = F.size(F.array_intersect(F.array(*cells), known))
    other = ~same & (alike > 1) & (2 * alike > F.size(F.array_compact(F.array(*cells))))
    rows = rows.withColumns({"_header": same, "_other": other})
    if observation is not None:
        rows = rows.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~F.col("_utf8")).alias("gb18030"),
            F.count_if("_header").alias("headers"),
            F.count_if(F.col("_broken").isNotNull()).alias("broken"),
        )
    stays = ~F.col("_header")
    if strict:
        stays = (
            F.when(F.col("_other"), _stop("another header: ", F.array_join(F.array(*cells), ",")))
            .when(F.col("_broken").isNotNull(), _stop("not as many cells as the header: ", F.col("_broken")))
            .otherwise(stays)
        )
    kept = rows.where(stays).select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])
    return blank_to_null(kept)


def _is_utf8(row: Column) -> Column:
    """Whether bytes, given as one letter each, are UTF-8; most rows are plain ASCII."""
    return ~row.rlike("[\\x80-\\xff]") | F.is_valid_utf8(F.encode(row, "ISO-8859-1").cast("string"))


def _text(cell: Column, utf8: Column) -> Column:
    octets = F.encode(cell, "ISO-8859-1")
    return (
        F.when(~cell.rlike("[\\x80-\\xff]"), cell)
        .when(utf8, octets.cast("string"))
        .otherwise(F.decode(octets, "GB18030"))
    )


def _stop(why: str, what: Column) -> Column:
    return F.raise_error(F.concat(F.lit(why), F.substring(what, 1, 200))).cast("boolean")


def file_kinds(
    spark: SparkSession, paths: str | Sequence[str]
) -> dict[tuple[str, bool, str], list[str]]:
    """Paths by (charset, has line breaks inside quotes, header fingerprint).

    Files that are not valid UTF-8 are GB18030, which also reads every GBK
    file. Only a quote that opens a cell and is not closed on its line makes a
    file one with line breaks; an inch mark does not. The check runs on the executors line by line; only one short row per
    file comes back.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    # The text reader passes bytes through as they are. Bytes of a GB18030
    # character are never a quote or a line break.
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        # Ids grow along a split, so the smallest pair is the header line.
        F.struct(
            "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")
        ).alias("place"),
    )
    # What is left of a line without its whole quoted cells starts a cell that goes on.
    bare = F.regexp_replace("value", r'(^|,)"(?:[^"]|"")*+"(?=,|\r?$)', "$1")
    per_file = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("is_utf8"),
        F.bool_or(bare.rlike('(^|,)"')).alias("multi_line"),
        F.md5(F.min_by("value", "place").cast("binary")).alias("header"),
    )
    kinds: dict[tuple[str, bool, str], list[str]] = {}
    for row in per_file.collect():
        charset = "UTF-8" if row.is_utf8 else "GB18030"
        # The path comes percent-encoded, and the reader expands wildcards.
        path = re.sub(r"([\[\]{}*?])", r"\\\1", unquote(row.path))
        kinds.setdefault((charset, row.multi_line, row.header), []).append(path)
    return kinds


def read_exports(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Exports of mixed charsets and layouts as one DataFrame of text columns.

    Files with the same header are read together, so that a column is found by
    its name and not by its place. Finding out takes a pass of its own: use
    ``read_uniform_exports`` where the files share a header, whatever their
    charsets, and ``read_csv`` where the charset is known as well.
    """
    frames = [
        read_csv(spark, sorted(files), charset, multi_line)
        for (charset, multi_line, _), files in sorted(file_kinds(spark, paths).items())
    ]
    if not frames:
        return read_csv(spark, paths)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    by: Iterable[str] = (),
    file_size: str = "128m",
    utf8_mark: bool = False,
) -> None:
    """Write as Parquet or CSV with a header, split by the ``by`` columns.

    Rows are rebalanced first, by market if there is one: a market's files
    follow its bytes, about ``file_size`` of shuffled rows in each, so a hot one
    has several and small ones one each, but for those that share a shuffle
    partition with a hot one. ``utf8_mark`` starts CSV files with the
    mark by which spreadsheet programs tell UTF-8.
    """
    by = list(by)
    if utf8_mark and fmt == "csv" and df.columns:
        first = next(c for c in df.columns if c not in by)
        df = df.withColumnRenamed(first, "\ufeff" + first).select(
            "\ufeff" + first, *[F.col(f"`{c}`") for c in df.columns if c != first]
        )
    conf = df.sparkSession.conf
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": file_size, "spark.sql.adaptive.enabled": "true"}
    before = {name: conf.get(name, None) for name in sizes}
    try:
        for name, value in sizes.items():
            conf.set(name, value)
        spread = df.hint("rebalance", *by)
        writer = spread.write.mode("errorifexists").format(fmt).option("header", True)
        if by:
            writer = writer.partitionBy(*by)
        writer.save(path)
    finally:
        for name, value in before.items():
            if value is None:
                conf.unset(name)
            else:
                conf.set(name, value)
