"""Titles, words and attribute text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfsight.config import (
    IMAGE_URL_HEAD,
    IMAGE_URL_TAIL,
    KEYWORD_STOP_WORDS,
    TITLE_FILLER_WORDS,
    UNKNOWN_TITLE,
)
from shelfsight.functions.numbers import strip

# \s alone is ASCII-only here; \p{Z} adds the Unicode spaces.
SPACES = r"\s\x0B\x1C-\x1F\x85\p{Z}"
NOT_WORD_OR_SPACE = rf"[^\p{{L}}\p{{N}}_{SPACES}]"
ATTRIBUTE_PAIR = r"([^:|]+):([^|]+)"


def words(text: Column) -> Column:
    """Lower-cased words with punctuation removed (not split at it)."""
    bare = F.regexp_replace(F.lower(text), NOT_WORD_OR_SPACE, "")
    return F.split(bare, rf"[{SPACES}]+")


def is_keyword(word: Column) -> Column:
    """Longer than two characters, not a stop word, not all digits."""
    return (
        (F.length(word) > 2)
        & ~word.isin(*KEYWORD_STOP_WORDS)
        & ~word.rlike(r"^\p{Nd}+$")
    )


def short_title(title: Column) -> Column:
    """First 50 characters and an ellipsis."""
    return F.concat(F.substring(title, 1, 50), F.lit("..."))


def core_title(title: Column) -> Column:
    """First five telling words of a title, which name its product family."""
    tokens = F.split(F.lower(title), rf"[{SPACES}]+")
    telling = F.filter(
        tokens, lambda w: (F.length(w) > 2) & ~w.isin(*TITLE_FILLER_WORDS)
    )
    joined = F.array_join(F.slice(telling, 1, 5), " ")
    return F.when(title.isNull(), F.lit(UNKNOWN_TITLE)).otherwise(joined)


def image_url(asin: Column) -> Column:
    """Image address derived from the listing id."""
    return F.concat(F.lit(IMAGE_URL_HEAD), strip(asin), F.lit(IMAGE_URL_TAIL))


def attribute_map(text: Column) -> Column:
    """'Color:Red|Size:M' to a map; the last of equal keys wins.

    Later duplicates are resolved here rather than by a session setting, so
    the result does not depend on who built the session.
    """
    pairs = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ATTRIBUTE_PAIR), 0),
        lambda p: F.struct(
            strip(F.substring_index(p, ":", 1)).alias("key"),
            strip(F.substring(p, F.locate(":", p) + 1, F.length(p))).alias("value"),
        ),
    )
    # The one-element array binds the pairs to a name, so that the text is
    # taken apart once and not again for every pair.
    return F.transform(
        F.array(pairs), lambda found: F.map_from_entries(_last_of_each_key(found))
    )[0]


def _last_of_each_key(pairs: Column) -> Column:
    def repeated_later(pair: Column, i: Column) -> Column:
        later = F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1)))
        return F.exists(later, lambda other: other["key"] == pair["key"])

    return F.filter(pairs, lambda pair, i: ~repeated_later(pair, i))
