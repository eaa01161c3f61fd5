from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from samples import odd_rows, said

from shelfsight.llm import mixing, packing, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no tokenizer files")


def corpus(count=400):
    rng = random.Random(12)
    sources = ["a", "b", "b", "b", "c", None]
    return [(i, said(rng, rng.randint(0, 120)), sources[i % 6]) for i in range(count)] + [(900, said(rng, 9000), "c")]


def shared(sizes):
    """Targets by repeated fair sharing, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed = {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        goal = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = {s: 3 * sizes[s] for s in rest if goal[s] > 3 * sizes[s]}
        if not over:
            return fixed | goal
        fixed |= over


def test_targets_are_met_and_no_document_comes_too_often(documents):
    rows = corpus()
    found = mixing.Mix(documents(rows)).taken().collect()
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    sums, taken = Counter(), Counter()
    for i, _, s in rows:
        sums[s] += size[i]
    goal = shared(sums)
    for r in found:
        assert r["size"] == size[r.doc_id] and r.source_size == sums[r.source]
        assert r.target == pytest.approx(goal[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert len(found) == len(rows)
    for s, want in goal.items():
        assert abs(taken[s] - want) <= 2 * mixing.BLOCK_WORDS


def test_reruns_and_partitions_agree(documents):
    docs = documents(corpus())
    one = sorted(map(str, mixing.Mix(docs).taken().collect()))
    assert one == sorted(map(str, mixing.Mix(docs.repartition(13)).taken().collect()))


def test_the_schedule_is_even_everywhere(documents):
    plan = mixing.Mix(documents(corpus()))
    rows = sorted((r.slot, r.sid, r.block) for r in plan.schedule().collect())
    assert [r[0] for r in rows] == list(range(plan.slots))
    seen = Counter()
    whole = sum(t for *_, t, _ in plan.sources)
    for slot, sid, block in rows:
        assert block == seen[sid]
        seen[sid] += 1
        for k, _, _, goal, _ in plan.sources:
            assert abs(seen[k] - (slot + 1) * goal / whole) < 4


def test_mixed_texts_hold_the_words_taken(documents):
    docs = documents(corpus())
    taken = {r.doc_id: r.taken for r in mixing.Mix(docs).taken().collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    texts = {i: t for i, t, _ in corpus()}
    sums = Counter()
    for r in out.collect():
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        sums[r.doc_id] += len(WORD.findall(r.text))
    assert sums == Counter({i: n for i, n in taken.items() if n})


def test_mixing_odd_rows(documents):
    docs = documents(odd_rows())
    found = mixing.Mix(docs).taken().collect()
    assert len(found) == len(odd_rows()) and all(r.taken <= 3 * r["size"] for r in found)
    assert mixing.mixed(docs).where("trim(text) = '' or text is null").count() == 0
    empty = docs.where("false")
    assert mixing.Mix(empty).taken().count() == 0 and mixing.mixed(empty).count() == 0
    blank = docs.where("doc_id in (1, 2, 4)")
    assert [r.taken for r in mixing.Mix(blank).taken().collect()] == [0, 0, 0] and mixing.mixed(blank).count() == 0


@TOKENIZER
def test_every_token_is_packed_once(documents):
    from tokenizers import Tokenizer

    rows = corpus(300) + [(1000, "é 😀 \n\n  two   spaces\tand tabs", "a"), (1001, None, None), (1002, "", "b")]
    coder = Tokenizer.from_file(tokens.tokenizer_paths()["json"])
    found = packing.packed(documents(rows)).collect()
    ids = tokens.Tokens(tokens.tokenizer_paths())
    of = {i: np.append(ids.ids(t or ""), np.uint16(0)) for i, t, _ in rows}
    for i, t, _ in rows:
        assert of[i][:-1].tolist() == coder.encode(t or "", add_special_tokens=False).ids
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
        part = of[r.doc_id][r.start : r.start + r.length].astype("<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(of[r.doc_id])
    for held in [*pieces.values(), *windows.values()]:
        at = 0
        for start, length in sorted(held):
            assert start == at and length > 0
            at += length
    assert {i: sum(n for _, n in held) for i, held in pieces.items()} == {i: len(x) for i, x in of.items()}
    assert all(sum(n for _, n in held) <= 1024 for held in windows.values())


def test_neighbours_share_terms():
    rng = np.random.default_rng(0)
    docs = [rng.integers(1000 * (k % 4), 1000 * (k % 4) + 300, 200) for k in range(40)]
    index = packing.Bm25(docs)
    used = np.zeros(40, dtype=bool)
    used[0] = True
    near = index.neighbours(0, used)
    assert len(near) and all(int(k) % 4 == 0 for k in near) and 0 not in near
    for window in packing.windows(docs, 1024):
        assert sum(length for *_, length in window) <= 1024
    first = next(packing.windows(docs, 1024))
    assert {d % 4 for d, *_ in first} == {0}


@TOKENIZER
def test_packing_odd_rows(documents):
    docs = documents(odd_rows())
    found = packing.packed(docs).collect()
    assert sum(r.start == 0 for r in found) == len(odd_rows())
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)
    assert packing.packed(docs.where("false")).count() == 0


@TOKENIZER
def test_related_documents_meet_wherever_they_are_stored(documents):
    rng = random.Random(8)
    words = [[said(rng, 1) for _ in range(40)] for _ in range(30)]
    # Thirty subjects of twenty documents each, the documents of one subject thirty rows apart.
    rows = [(i, " ".join(f"{w}{i % 30}" for w in rng.sample(words[i % 30], 30)), "a") for i in range(600)]
    for docs in (documents(rows), documents(rows).repartition(7)):
        windows = defaultdict(list)
        for r in packing.packed(docs, window=256, shard_docs=60).collect():
            windows[r.sequence_id].append(r.doc_id % 30)
        pairs = [(a, b) for w in windows.values() for a, b in zip(w, w[1:])]
        assert sum(a == b for a, b in pairs) > 0.7 * len(pairs)


@TOKENIZER
def test_statistics_span_all_partitions(documents):
    rows = corpus(100)
    coder = tokens.Tokens(tokens.tokenizer_paths())
    want = packing.Statistics.of([np.append(coder.ids(t or ""), np.uint16(0)) for _, t, _ in rows])
    found = packing.statistics(packing._tokenized(documents(rows).repartition(5), tokens.tokenizer_paths()))
    assert found.n == want.n and found.mean == pytest.approx(want.mean) and (found.df == want.df).all()


def test_neighbours_fill_a_window_whatever_their_number():
    rng = np.random.default_rng(1)
    docs = [rng.integers(1000 * (k % 2), 1000 * (k % 2) + 20, 6) for k in range(600)]
    first = next(packing.windows(docs, 1024))
    assert len(first) > 150 and {d % 2 for d, *_ in first} == {0}


def test_equal_scores_go_by_place():
    docs = [np.array([5, 6, 7, 8]) for _ in range(300)] + [np.array([9, 10])]
    used = np.zeros(301, dtype=bool)
    used[7] = True
    near = packing.Bm25(docs).neighbours(7, used, 400)
    assert near[:100].tolist() == [k for k in range(101) if k != 7]


def test_terms_of_one_document_ask_for_nothing():
    rng = np.random.default_rng(2)
    own = [np.arange(100 + 50 * k, 150 + 50 * k) for k in range(20)]
    docs = [np.r_[own[k], np.arange(k % 4 * 5, k % 4 * 5 + 5)][rng.permutation(55)] for k in range(20)]
    near = packing.Bm25(docs).neighbours(0, np.arange(20) == 0)
    assert near.tolist() == [4, 8, 12, 16]


def test_small_sources_beside_a_huge_one_meet_their_targets(documents):
    rng = random.Random(3)
    sizes = {"a": 60_000, "y": 30, "z": 41, "b": 7, "c": 90, "d": 200, None: 1}
    rows, i = [], 0
    for source, size in sizes.items():
        while size:
            part = min(size, 1000)
            rows.append((i, said(rng, part), source))
            size, i = size - part, i + 1
    docs = documents(rows)
    plan = mixing.Mix(docs)
    taken, goal = Counter(), {}
    for r in plan.taken().collect():
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert goal == pytest.approx(shared(sizes))
    for source, want in goal.items():
        assert abs(taken[source] - want) <= max(0.5, 0.01 * want)
    assert {r.source for r in mixing.mixed(docs).select("source").distinct().collect()} == set(sizes)
    slots = Counter()
    for r in plan.pieces().collect():
        slots[r.slot] += r.words
    assert max(slots.values()) <= mixing.BLOCK_WORDS and max(slots) < plan.slots
    assert sorted(r.slot for r in plan.schedule().collect()) == list(range(plan.slots))


def test_neighbours_and_windows_equal_plain_bm25():
    """Scores by the textbook formula, and windows filled by them one document after the other."""
    rng = random.Random(21)
    docs = [np.array(rng.choices(range(40), [1 / (i + 1) for i in range(40)], k=rng.randint(1, 30)), dtype=np.uint16) for _ in range(60)]
    docs += [docs[3]] * 4
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d.tolist()))

    def weight(doc, term):
        count = doc.tolist().count(term)
        idf = np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
        return idf * count * (packing.K1 + 1) / (count + packing.K1 * (1 - packing.B + packing.B * len(doc) / mean))

    def ranked(seed, free):
        terms = sorted((t for t in set(docs[seed].tolist()) if df[t] > 1), key=lambda t: (-weight(docs[seed], t), t))[:5]
        score = {i: sum(weight(docs[i], t) for t in terms if t in docs[i]) for i in free}
        return sorted((i for i in free if score[i] > 0), key=lambda i: (-round(score[i], 9), i)), score

    index = packing.Bm25(docs, 5)
    for seed in range(n):
        used = np.zeros(n, dtype=bool)
        used[[seed, *rng.sample(range(n), 10)]] = True
        want, score = ranked(seed, [i for i in range(n) if not used[i]])
        got = index.neighbours(seed, used).tolist()
        assert sorted(got) == sorted(want)
        assert [round(score[i], 7) for i in got] == [round(score[i], 7) for i in want]

    free, waiting = list(range(n)), None
    for window in packing.windows(docs, 64, 5):
        seed, start = waiting or (free[0], 0)
        waiting = None
        if seed in free:
            free.remove(seed)
        assert window[0] == (seed, start, min(64, len(docs[seed]) - start))
        room = 64 - window[0][2]
        for place, (doc, begin, length) in enumerate(window[1:], 1):
            near, score = ranked(seed, free)
            best = score[near[0]] if near else 0
            assert doc in free and begin == 0 and length == min(room, len(docs[doc]))
            # The best that is left, or, where none is near, the next one.
            assert round(score[doc], 7) == round(best, 7) if near else doc == free[0]
            free.remove(doc)
            room -= length
            if length < len(docs[doc]):
                waiting = (doc, length)
                assert place == len(window) - 1
        assert room == 0 or not free
    assert not free and waiting is None


def test_batches_of_ids_equal_one_document_after_the_other():
    """Terms, heaviest terms and places of many documents at once, against counting each."""
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 90, k).astype(np.uint16) for k in [1, 700, *rng.integers(1, 80, 60)]]
    docs += [docs[2], np.array([65535], dtype=np.uint16), np.array([65535, 65535, 7], dtype=np.uint16)]
    bounds = np.r_[0, np.cumsum([len(d) for d in docs])]
    whole = packing.Statistics.of(docs)
    want = [(i, t, n) for i, d in enumerate(docs) for t, n in sorted(Counter(d.tolist()).items())]
    assert list(zip(*(x.tolist() for x in packing.terms(np.concatenate(docs), bounds)), strict=True)) == want
    places = packing.places_of(np.concatenate(docs), bounds, whole, 5)
    for doc, place in zip(docs, places, strict=True):
        counts = Counter(doc.tolist())
        weight = {t: whole.weights(np.array([t]), np.array([n]), len(doc))[0] for t, n in counts.items() if whole.df[t] > 1}
        asked = sorted(weight, key=lambda t: (-weight[t], t))[:5]
        least = sorted(int(packing.SHUFFLED[t]) for t in asked)[:4]
        least += [65535] * (4 - len(least))
        assert place + (1 << 63) == sum(x << 16 * (3 - k) for k, x in enumerate(least))
    assert [x.tolist() for x in packing.heaviest(np.array([2.0, 3, 2, 2, 3, 1]), np.array([0, 5, 5, 6]), 3)] == [[1, 4, 0], [], [5]]


@TOKENIZER
def test_ids_of_odd_texts_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(4)
    coder, ids = Tokenizer.from_file(tokens.tokenizer_paths()["json"]), tokens.Tokens(tokens.tokenizer_paths())
    letters = [*" \n\tab9.'sé中\x1c\x85 ​　😀", "  ", "\r\n", "the", " don't", tokens.SPECIAL]
    for text in ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(500)] + ["ab" * 20_000]:
        assert ids.ids(text).tolist() == coder.encode(text, add_special_tokens=False).ids
