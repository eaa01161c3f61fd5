from __future__ import annotations

import random

import numpy as np
from samples import odd_rows, said, words

from shelfsight.llm import near_duplicates as nd
from shelfsight.llm.common import WordHashes, shingles
from shelfsight.llm.components import components


def items_of(text):
    return shingles(WordHashes().of(nd.words_of(text)), nd.SHINGLE)


def common(a, b):
    """Longest common subsequence by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def alike(a, b):
    a, b = a.tolist(), b.tolist()
    if not a or not b:
        return False
    one, other = set(a), set(b)
    shared = common(a, b)
    return len(one & other) >= 0.8 * len(one | other) and shared >= 0.8 * (len(a) + len(b) - shared)


def classes_of(texts, pairs):
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        i, j = sorted((top(i), top(j)))
        root[j] = i
    return [top(i) for i in range(len(texts))]


def corpus():
    """Copies, near copies of every degree, and texts that share a passage only."""
    rng = random.Random(7)
    texts = []
    for _ in range(6):
        base = words(rng, 150)
        for edits in (0, 0, 1, 2, 4, 8, 12):
            text = list(base)
            for _ in range(edits):
                text[rng.randrange(len(text))] = "".join(words(rng, 1))
            texts.append(" ".join(text))
    passage = said(rng, 60)
    texts += [f"{passage} {said(rng, 80)}" for _ in range(10)]
    line = "is on "
    texts += [said(rng, 300) + " " + line * 300 for _ in range(8)]
    # A passage moved to the other end: the same shingles, another order.
    halves = said(rng, 70), said(rng, 70)
    texts += [" ".join(halves), " ".join(halves[::-1])]
    return texts


def test_classes_equal_brute_force(documents):
    texts = corpus()
    items = [items_of(t) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if alike(items[i], items[j])]
    expected = classes_of(texts, pairs)
    found = nd.near_duplicate_classes(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.class_id for r in found} == dict(enumerate(expected))
    assert sorted(r.doc_id for r in found if r.stays) == sorted(set(expected))


def test_alignment_equals_the_table():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
        b = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
        least = int(rng.integers(0, 30))
        exact = common(a.tolist(), b.tolist())
        found = nd.aligned(a, b, least)
        assert found == exact if exact >= least else found < least


def test_a_bucket_without_a_centre_is_settled(documents):
    rng = random.Random(1)
    base = words(rng, 120)
    texts = []
    for k in range(12):
        text = base[: 120 - 8 * k] + words(rng, 8 * k)
        texts += [" ".join(text), " ".join([*text[:-1], "end"])]
    items = [items_of(t) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if alike(items[i], items[j])]
    found = nd.near_duplicate_classes(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.class_id for r in found} == dict(enumerate(classes_of(texts, pairs)))


def test_odd_rows(documents):
    found = nd.near_duplicate_classes(documents(odd_rows())).collect()
    assert len(found) == len(odd_rows())
    classes = {}
    for r in found:
        classes.setdefault((r.class_id, r.copy), []).append(r)
    # NULL and empty are one text, equal rows one class, everything else stays apart.
    assert len(classes) == 8 - 1
    assert len({r.class_id for r in found if r.doc_id in (1, 4)}) == 1


def test_one_of_each_keeps_all_columns(documents):
    docs = documents(odd_rows())
    kept = nd.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(set(rows)) == 7


def test_no_rows(documents):
    assert nd.near_duplicate_classes(documents([(1, "", "a")]).where("false")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    links = spark.createDataFrame([(max(p), min(p)) for p in chain + star], "u long, v long")
    found = {r.node: r.root for r in components(links).collect()}
    assert all(found[i] == 0 for i in range(1, 41)) and all(found[100 + i] == 100 for i in range(1, 30))


def test_sketches_keep_text_order():
    rng = random.Random(2)
    a, b = items_of(said(rng, 100)), items_of(said(rng, 100))
    one = nd.order_minhash(np.r_[a, b], 24, 5)
    other = nd.order_minhash(np.r_[b, a], 24, 5)
    assert (one == nd.order_minhash(np.r_[a, b], 24, 5)).all() and (one != other).sum() > 12


def test_short_near_copies_are_found_one_and_all(documents):
    rng = random.Random(21)
    texts = []
    # 8 and 9 words are 4 and 5 shingles, which no sketch of five can have in common.
    for count in (8,) * 60 + (9, 12, 13, 13, 13, 20, 30, 44) * 20:
        base = words(rng, count)
        texts += [" ".join(base), " ".join([*base, *words(rng, 1)])]
    middle = words(rng, 29)
    texts += [" ".join([*middle[:k], *words(rng, 1), *middle[k:]]) for k in range(30)]
    items = [items_of(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if set(items[i].tolist()) & set(items[j].tolist())]
    want = classes_of(texts, [p for p in pairs if alike(items[p[0]], items[p[1]])])
    assert all(want[i] == want[i + 1] for i in range(0, 120, 2))
    found = nd.near_duplicate_classes(documents([(i, t, "s") for i, t in enumerate(texts)]))
    assert {r.doc_id: r.class_id for r in found.collect()} == dict(enumerate(want))
