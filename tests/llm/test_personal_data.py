from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from samples import odd_rows

from shelfsight.llm import private

TEXTS = [
    "write to jane.doe+x@mail.example.org, or a@b.c.d. from 10.0.0.1 and 256.1.1.1.",
    "1.2.3.4.5.6.7.8 9.9.9 1.2.3.4.5 0001.2.3.4 300.1.1.1.1.1",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1111, not 4111 1111 1111 1112; 12 34",
    "call +1 (415) 555-0100 or +49 30 1234567, +1 2, ++12345678901, +1234567890123456789",
    "@x.y a@b @@c.d e@f.g@h.i %@-.- a@b..c a.@b.c",
    "é 😀 x@y.zz 😀 10.1.2.3 +44 20 7946 0958",
    "5500 0000 0000 0004 1 2 3 5500-0000-0000-0004",
    None,
    "",
]


def luhn(digits):
    rest = [int(d) for d in digits[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(rest)) % 10 == 0


def by_patterns(text):
    """The contract's patterns, one after the other."""
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub(r"[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
    ]
    spans = []
    for k, (name, pattern, holds) in enumerate(kinds):
        spans += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text) if holds(m.group())]
    return sorted(spans)


def test_base_spans_equal_the_patterns(spark, documents, monkeypatch):
    docs = documents([(i, t, "s") for i, t in enumerate(TEXTS)])
    for r in private.personal_data(docs).collect():
        base = by_patterns(TEXTS[r.doc_id] or "")
        said = ",".join(f"{name}:{s}:{e}" for s, _, e, name in base)
        assert r.found.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        counts = [sum(b[1] == k for b in base) for k in range(4)]
        assert [r.found.n_email, r.found.n_ip, r.found.n_card, r.found.n_phone] == counts
        spans = r.found.spans.split(",") if r.found.spans else []
        assert set(said.split(",")) - {""} <= set(spans)
        for s, _, e, _ in base:
            assert TEXTS[r.doc_id][s:e] not in r.found.redacted or TEXTS[r.doc_id].count(TEXTS[r.doc_id][s:e]) > 1


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_of_random_texts(seed):
    import random

    rng = random.Random(seed)
    for _ in range(3000):
        text = "".join(rng.choices("0123456789" * 3 + "..--++@@ ()ab%_", k=rng.randint(0, 60)))
        assert sorted(private.base_spans(text)) == [b[:3] for b in by_patterns(text)]


def test_long_runs_take_linear_time():
    import time

    for text in ("a" * 400_000, "1." * 200_000, "+1 " * 150_000, "1 " * 200_000, "a@" * 200_000, "a.b@" * 100_000):
        began = time.time()
        private.base_spans(text)
        private.candidates(text)
        assert time.time() - began < 20


def test_the_trees_add_written_out_data(documents):
    rows = [
        (1, "reach me at john (at) example (dot) com any time", "s"),
        (2, "the bank account is DE89 3704 0044 0532 0130 00, thanks", "s"),
        (3, "released on 2024-05-06 as version 10.2.33, 1234.5678 units in 3 parts", "s"),
    ]
    found = {r.doc_id: r.found for r in private.personal_data(documents(rows)).collect()}
    assert "email" in found[1].spans and "iban" in found[2].spans and found[3].spans == ""
    assert "john" not in found[1].redacted and found[3].redacted == rows[2][1]


def test_odd_rows(documents):
    docs = documents(odd_rows())
    found = private.personal_data(docs)
    assert found.columns == [*docs.columns, "found"] and found.count() == len(odd_rows())
    assert found.where(F.col("found.redacted") != F.coalesce("text", F.lit(""))).count() == 0
    assert private.personal_data(docs.where("false")).count() == 0


def test_numbers_side_by_side_are_all_redacted(documents):
    rows = [
        (1, "please call 555-123-4567 555-987-6543 today", "s"),
        (2, "tel 555-123-4567 / 555-987-6543 or write", "s"),
        (3, "paid by card 4111 1111 1111 1111 12/27 yesterday", "s"),
        (4, "call (212) 555-0188 2024-05-06 again", "s"),
    ]
    found = {r.doc_id: r.found.redacted for r in private.personal_data(documents(rows)).collect()}
    for i in (1, 2):
        assert not re.search("[0-9]{3}", found[i]) and found[i].count("[PHONE]") == 2
    assert "[CARD]" in found[3] and "1111" not in found[3]
    assert "[PHONE]" in found[4] and "0188" not in found[4]


def test_all_runs_of_digit_groups_are_proposed():
    text = "x 12 345-6789 (212) 555.0188 4111 1111 1111 1111 12/27 2024-05-06 a77 1234567b 0612 34 56 78 90"
    proposed = {(s, e) for s, _, e in private.candidates(text)}
    for span in ("12 345-6789", "345-6789", "(212) 555.0188", "4111 1111 1111 1111", "1111 12/27", "2024-05-06", "0612 34 56 78 90"):
        at = text.index(span)
        assert (at, at + len(span)) in proposed
    assert not any(text[e : e + 1].isalpha() or text[s - 1].isalnum() for s, e in proposed)


def test_spans_beyond_a_base_span_are_kept():
    judge = private.Judge([(private.features(t, s, k, e), y) for t, s, k, e, y in private.examples()])
    text = "bank DE89 3704 0044 0532 0130 00 thanks"
    iban = (5, 4, 32)
    assert judge.extra(text, [(10, 2, 32)]) == [iban] and judge.extra(text, [iban]) == []
