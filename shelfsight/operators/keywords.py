"""Word frequency of titles or any other text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.functions.text import is_keyword, words
from shelfsight.operators.common import top_n


def keyword_counts(
    df: DataFrame, column: str = "title", by: Sequence[str] = ()
) -> DataFrame:
    """How often each keyword occurs; hot words collapse before the shuffle.

    Whether a word is a keyword is asked once for each distinct word: words pass
    a generator first, below which the question would be asked of every one.
    """
    counted = (
        df.select(*by, F.explode(words(F.col(column))).alias("word"))
        .groupBy(*by, "word")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    each = counted.select(*by, F.inline(F.array(F.struct("word", "frequency"))))
    return each.where(is_keyword(F.col("word")))


def top_keywords(
    df: DataFrame, column: str = "title", n: int = 30, by: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` most frequent keywords, alphabetical on ties."""
    counts = keyword_counts(df, column, by)
    return top_n(counts, [F.desc("frequency"), F.asc("word")], n, by)
