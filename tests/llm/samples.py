from __future__ import annotations

import random

SYLLABLES = ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se"]


def words(rng: random.Random, count: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(count)]


def said(rng: random.Random, count: int) -> str:
    return " ".join(words(rng, count))


def odd_rows():
    """Nulls, empty and blank texts, repeated rows and ids, and a very long text."""
    rng = random.Random(4)
    long = said(rng, 30_000)
    return [
        (None, None, None),
        (None, "only here and nowhere else", None),
        (1, "", "a"),
        (2, " \n\t ", "a"),
        (3, "the same row twice over and over", "b"),
        (3, "the same row twice over and over", "b"),
        (3, "another row under one id", "b"),
        (4, None, "b"),
        (5, long, "a"),
        (6, "one", None),
    ]
