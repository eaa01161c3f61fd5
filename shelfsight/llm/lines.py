"""Quality rules of a document, and lines that too many documents of its host share.

Each line is normalised and hashed, and a document names each of its lines once,
so counting documents is one grouped sum over (host, line), which Spark adds up
on the map side first, whatever the size of a host and however common a line.
Lines above the limits are removed from the text; a document that loses too much,
or has too little left, is depleted and rejected.

Texts are read once: their measures and line hashes are kept in Parquet in the
shared folder, and only these go through shuffles. Few lines are above the
limits, and only rows that hold one of them are joined back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import SPACES, WORD, stored, text_of

LEAST_WORDS = 50
REPEATED_PERCENT = 50
WINDOW = 3
SYMBOLS = "[#*$%&|<>]"
DOCUMENTS = 10  # A line may always be in this many documents of its host,
SHARE = 0.001  # or in this share of them.
LEFT_WORDS = 50
LEFT_PERCENT = 50


def normal(line: Column) -> Column:
    """Lower case, runs of blanks as one and none at the ends, runs of digits as one zero."""
    spaced = F.trim(F.regexp_replace(line, SPACES, " "))
    return F.regexp_replace(F.lower(spaced), "[0-9]+", "0")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def has_word(line: Column) -> Column:
    return F.regexp_like(line, F.lit(WORD))


def repeated(words: list[str], window: int = WINDOW) -> int:
    """How many of the words lie in a run of ``window`` words found twice or more."""
    if len(words) <= window:
        return 0
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    # Runs as numbers of their own: each step pairs the run so far with the next word.
    run = ids
    for i in range(1, window):
        _, run = np.unique(run[:-1] * len(known) + ids[i:], return_inverse=True)
    twice = np.bincount(run)[run] > 1
    held = np.zeros(len(words), dtype=bool)
    for i in range(window):
        held[i : i + len(twice)] |= twice
    return int(held.sum())


def repeated_words(text: Column) -> Column:
    """n_repeat_words of a text that is not NULL; only the six blanks break words."""

    def counts(texts: pa.Array) -> pa.Array:
        breaks = str.maketrans("\t\n\x0b\x0c\r", "     ")
        found = ([w for w in t.translate(breaks).split(" ") if w] for t in texts.to_pylist())
        return pa.array([repeated(w) for w in found], pa.int64())

    return F.arrow_udf(counts, "long")(text)


def measured(text: Column) -> dict[str, Column]:
    """The base measures of a text that is not NULL."""
    lines = F.filter(F.split(text, "\n"), has_word)
    return {
        "n_words": word_count(text),
        "word_chars": F.char_length(F.regexp_replace(text, SPACES, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(text),
    }


def lines_of(text: Column) -> Column:
    """(hash of the normalised line, words) of each line that has a word."""
    lines = F.filter(F.split(text, "\n"), has_word)
    return F.transform(lines, lambda x: F.struct(F.xxhash64(normal(x)).alias("line"), word_count(x).alias("words")))


def frequent_lines(noted: DataFrame, documents: int = DOCUMENTS, share: float = SHARE) -> DataFrame:
    """(host, line) of ``noted`` (host, lines) found in more documents of the host than both limits allow."""
    hosts = noted.groupBy("host").agg(F.count("*").alias("held"))
    counted = noted.select("host", F.explode(F.array_distinct("lines.line")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("found"))
    # What is above the fixed limit is little; only that meets the number of documents of its host.
    common = counted.where(F.col("found") > documents)
    both = common.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
    return both.where(F.col("found") > F.floor(F.col("held") * F.lit(share))).select("host", "line")


def line_rules(
    rows: DataFrame,
    host: Column | None = None,
    documents: int = DOCUMENTS,
    share: float = SHARE,
    least_words: int = LEAST_WORDS,
    repeated_percent: int = REPEATED_PERCENT,
    left_words: int = LEFT_WORDS,
    left_percent: int = LEFT_PERCENT,
    texts: bool = True,
) -> DataFrame:
    """``rows`` (doc_id, text and others) with a struct ``rules``.

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than ``least_words`` words, or more than
    ``repeated_percent`` percent of them in repeated runs), removed (lines taken
    out), left_words, kept, and text, the document without the removed lines.

    A line is removed wherever it stands if, normalised, it is in more than
    ``documents`` rows of its ``host`` (``source`` if not given) and in more than
    the ``share`` of the host's rows. A document is kept if it has not failed and
    the removal leaves it ``left_words`` words and ``left_percent`` percent of its
    own; one that loses nothing is kept if it has not failed.

    A NULL text is an empty one and fails; its rules.text is empty. Rows without
    a host share one. Each row counts as a document, rows that repeat another in all columns
    too; a line repeated within a row counts once. A single line of any length is
    one line, and whole texts are read. An empty table gives an empty one. A
    column of ``rows`` named ``rules`` is refused with a ValueError; any other
    name may be there. Without ``texts`` neither ``text`` nor rules.text comes
    back, and no text is written to the shared folder. The session's Arrow
    batches stay as they are: ``spark.sql.execution.arrow.maxBytesPerBatch``
    bounds the texts that a Python worker holds.
    """
    if "rules" in rows.columns:
        raise ValueError("the rows have a column named 'rules'")
    host = F.col("source") if host is None else host
    carried = [c for c in rows.columns if texts or c != "text"]
    own = F.struct(*[F.col(f"`{c}`") for c in carried])
    base = rows.select(own.alias("own"), host.alias("host"), text_of("text").alias("text"))
    noted = base.select(
        "own",
        "host",
        F.monotonically_increasing_id().alias("row"),
        F.struct(*[c.alias(n) for n, c in measured(F.col("text")).items()]).alias("base"),
        lines_of(F.col("text")).alias("lines"),
    )
    noted = stored(noted)
    frequent = stored(frequent_lines(noted, documents, share)).toDF("_host", "_line")
    named = noted.select("row", "host", F.inline("lines"))
    met = named.join(frequent, F.col("line").eqNullSafe(F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")))
    met = met.groupBy("row").agg(
        F.sum("words").alias("gone"), F.count("*").alias("removed"), F.collect_set("line").alias("frequent")
    )
    joined = noted.join(met, "row", "left")

    words = F.col("base.n_words")
    left = words - F.coalesce("gone", F.lit(0))
    failed = (words < least_words) | (100 * F.col("base.n_repeat_words") > repeated_percent * words)
    enough = (left >= left_words) & (100 * left >= left_percent * words)
    rules = [
        F.col("base.*"),
        failed.alias("base_failed"),
        F.coalesce("removed", F.lit(0)).alias("removed"),
        left.alias("left_words"),
        (~failed & (F.col("gone").isNull() | enough)).alias("kept"),
    ]
    if texts:
        whole = F.coalesce(F.col("own.text"), F.lit(""))
        stays = lambda x: ~(has_word(x) & F.array_contains("frequent", F.xxhash64(normal(x))))
        cut = F.array_join(F.filter(F.split(whole, "\n"), stays), "\n")
        rules.append(F.when(F.col("frequent").isNull(), whole).otherwise(cut).alias("text"))
    return joined.select(F.col("own.*"), F.struct(*rules).alias("rules"))
