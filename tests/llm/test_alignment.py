from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from samples import odd_rows, said

from shelfsight.llm import alignment

pytestmark = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no tokenizer files")

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "plain words of one line",
    "  two blanks, a tab\tand\n\nnew lines \r\n at the end  ",
    "ünïcödé 中文字符 русский текст 😀😀 한국어",
    "aaaaaaaaaaaaaaaa aaaa aaaaaaa 1111111111 22222",
    "<|endoftext|> </s> <s> <unk> <0x41> ▁▁ [INST]",
    "  odd　blanks​ \x01\x7f ﻿ é ﬁ",
    "x",
    " ",
]


@pytest.fixture(scope="module")
def coders():
    return alignment.Coders(alignment.tokenizer_paths())


def plain(coders, text):
    """Groups and links of a text, from the ranges of all its tokens."""
    want = (" " + (text or "")).encode()
    a = coders.first.encode(" " + (text or ""), add_special_tokens=False).ids
    b = coders.second.encode(text or "")
    ranges = []
    for ids, spelled in ((a, coders.a), (b, coders.b)):
        at, side = 0, []
        for i in ids:
            side.append((at, at + len(spelled[i]), i))
            at += len(spelled[i])
        ranges.append(side)
        if not text or b"".join(spelled[i] for i in ids) != want:
            return [], [], [], []
    links = [(p[2], q[2]) for p in ranges[0] for q in ranges[1] if p[0] < q[1] and q[0] < p[1]]
    ends = sorted({r[1] for r in ranges[0]} & {r[1] for r in ranges[1]})
    groups = [[[r[2] for r in side if start < r[1] <= end] for side in ranges] for start, end in zip([0, *ends], ends, strict=False)]
    return a, b, groups, links


def brute(coders, rows):
    found = [plain(coders, text) for _, text, _ in rows]
    counts = Counter(pair for *_, links in found for pair in set(links))
    highest = Counter()
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    out = []
    for (doc, _, _), (a, b, groups, links) in zip(rows, found, strict=True):
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        best = sum(counts[p] == highest[p[0]] for p in links)
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [1, 40, 100_000])
def test_links_equal_brute_force(spark, documents, coders, frequent):
    rng = random.Random(6)
    rows = [(i, t, "a") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, said(rng, rng.randint(1, 60)), "b") for i in range(60)]
    rows += [(200 + i, "the same copy " + said(random.Random(1), 30), "b") for i in range(30)]
    rows += [r for r in odd_rows() if len(r[1] or "") < 1000]
    found = alignment.link_counts(documents(rows), frequent=frequent)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(coders, rows)


def test_a_very_long_text_is_aligned_whole(spark, documents, coders):
    rows = [r for r in odd_rows() if len(r[1] or "") > 1000]
    (found,) = alignment.link_counts(documents(rows)).collect()
    a = coders.first.encode(" " + rows[0][1], add_special_tokens=False).ids
    assert found.n_a == len(a) and found.n_groups > 10_000 and found.n_links >= found.n_groups


def test_groups_spell_the_text(spark, documents, coders):
    rows = [(i, t, "a") for i, t in enumerate([*TEXTS, None, ""])]
    found = {r.doc_id: r.groups for r in alignment.aligned(documents(rows)).collect()}
    for i, text, _ in rows:
        a, b, groups, _ = plain(coders, text)
        assert [[list(g.a), list(g.b)] for g in found[i]] == groups
    assert found[0] and not found[8] and not found[9]


def test_irregular_groups_can_hold_pairs_of_the_array(coders):
    text = TEXTS[3]
    a, b, groups, links = plain(coders, text)
    (m,) = alignment.Notes(coders).of([text])
    held = Counter({(i, int(coders.same[i])): n for i, n in zip(m.same.tolist(), m.same_times.tolist(), strict=True)})
    held += Counter({divmod(p, len(coders.b)): n for p, n in zip(m.pairs.tolist(), m.pair_times.tolist(), strict=True)})
    assert held == Counter(links) and (m.n_a, m.n_b, m.n_groups, m.n_links) == (len(a), len(b), len(groups), len(links))
    assert all(coders.b[coders.same[i]] == coders.a[i] for i in range(len(coders.a)) if coders.same[i] >= 0)


def test_parts_give_what_whole_texts_give(coders):
    rng = random.Random(1)
    bits = ["a", "b ", " ", "\n", "\t", "é", "\xa0", "\u3000", "<|endoftext|>", "</s>", "▁", "1", "23", "'s", "ab", "The"]
    bits += ["\x1c", "\x85", "\r\n", "中", "😀", "  ", "\x00", "ﬁ", "e\u0301"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(3000)]
    met = 0
    for text, note in zip(texts, alignment.Notes(coders).of(texts), strict=True):
        ids = coders.ids([text])
        if ids is None:
            assert note == alignment.NOTHING
            continue
        links = alignment.Links(coders, *ids)
        assert note.groups == "".join(links.marked(coders.numbers))[:-1]
        assert (note.n_a, note.n_b, note.n_links) == (len(ids[0]), len(ids[1]), len(links.same) + len(links.pairs))
        assert np.repeat(note.same, note.same_times).tolist() == sorted(links.same.tolist())
        assert np.repeat(note.pairs, note.pair_times).tolist() == sorted(links.pairs.tolist())
        met += 1
    assert met > 1000


def test_notes_are_the_same_however_much_is_kept(coders, monkeypatch):
    rng = random.Random(7)
    texts = [said(rng, rng.randint(1, 30)) + rng.choice(TEXTS) for _ in range(400)]

    def noted():
        notes = alignment.Notes(coders)
        found = [n for i in range(0, 400, 20) for n in notes.of(texts[i : i + 20])]
        return [(*n[:5], *(x.tolist() for x in n[5:])) for n in found]

    want = noted()
    monkeypatch.setattr(alignment, "KNOWN", 50)
    assert noted() == want
    monkeypatch.setattr(alignment, "KNOWN_LETTERS", 300)
    assert noted() == want


def test_no_rows(spark, documents):
    found = alignment.link_counts(documents([(1, "x", "a")]).where("false"))
    assert found.columns == COLUMNS and found.count() == 0
