from __future__ import annotations

import random
import re

from samples import odd_rows, said

from shelfsight.llm import licences


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def runs(items):
    return [tuple(items[i : i + 3]) for i in range(len(items) - 2)]


def best_window(text, template):
    """Greatest containment of the template in any window of the class's length and start."""
    wanted = set(runs(words(template)))
    stride = max(4, 1 << (len(words(template)) - 1).bit_length())
    found, size = runs(words(text)), 2 * stride - 2
    places = range(0, len(found), stride)
    return max((len(wanted & set(found[k : k + size])) / len(wanted) for k in places), default=0)


def texts():
    rng = random.Random(9)
    out = []
    for k, (_, template) in enumerate(licences.TEMPLATES):
        for cut in (0, 1, 3):
            notice = template.split()
            for _ in range(cut):
                notice[rng.randrange(len(notice))] = "word"
            out.append(f"{said(rng, 7 * k)} {' '.join(notice).upper() if cut else ' '.join(notice)} {said(rng, 40)}")
    out += [said(rng, 200) for _ in range(5)]
    out.append(" ".join(t for _, t in licences.TEMPLATES) * 3)
    return out


def test_equals_brute_force(documents):
    found = licences.scanned(documents([(i, t, "s") for i, t in enumerate(texts())])).collect()
    expected = {}
    for i, t in enumerate(texts()):
        for name, template in licences.TEMPLATES:
            share = best_window(t, template)
            if share >= 0.8:
                expected[i, name] = max(share, expected.get((i, name), 0))
    assert {(r.doc_id, r.license): round(r.containment, 9) for r in found} == {k: round(v, 9) for k, v in expected.items()}


def test_a_notice_late_in_a_long_text(documents):
    rng = random.Random(3)
    text = said(rng, 50_000) + " Released under the MIT License. " + said(rng, 10)
    (r,) = licences.scanned(documents([(1, text, "s"), (1, text, "s")])).collect()
    assert (r.doc_id, r.license, r.containment) == (1, "MIT", 1.0) and 49_984 <= r.first_word <= 50_000


def test_odd_rows(documents):
    docs = documents(odd_rows())
    assert licences.scanned(docs).count() == 0 and licences.scanned(docs.where("false")).count() == 0


def test_bands_guarantee_the_probability(spark):
    index = licences.Index(spark)
    for t, items in index.sets.items():
        stride, need = index.stride[t], -(-4 * len(items) // 5)
        alike = need / (2 * stride - 2 + len(items) - need)
        assert (1 - alike) ** index.bands[stride] <= 1e-4


def test_templates_are_broadcast_and_nothing_else(spark, documents):
    docs = documents([(i, t, "s") for i, t in enumerate(texts())])
    plan = licences.scanned(docs)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("BuildRight") == 2 and "SortMergeJoin" not in plan
    found = licences.scanned(docs)
    found.collect()
    done = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Documents are exchanged once, when containment has decided.
    below = done[done.index("BroadcastHashJoin") :]
    assert "hashpartitioning" not in below
