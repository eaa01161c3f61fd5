from __future__ import annotations

import math

import numpy as np
import pytest

from shelfsight.llm import negatives

ODD = [
    (None, 1, [1.0, 2.0, 3.0, 4.0]),
    (5000, None, [1.0, 2.0, 3.0, 4.0]),
    (5050, 1, None),
    (5100, 1, []),
    (5150, 1, [1.0, None, 0.0, 0.0]),
    (5200, 1, [1.0, float("nan"), 0.0, 0.0]),
    (5250, 1, [float("inf"), 0.0, 0.0, 0.0]),
]
ALONE = [(5300, 1, [0.0, 0.0, 0.0, 0.0]), (5350, 2, [1.0, 2.0]), (5351, 2, [2.0, 2.0]), (5352, 3, [1.0, 1.0])]


def table(spark, rows):
    rows = [(i, v, c, 1, 2, "y", 4, 5) for i, c, v in rows]
    return spark.createDataFrame(
        rows, "vec_id long, embedding array<double>, label int, anchor int, dims int, part string, place int, block int"
    )


def vectors(count=500, dims=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, dims)) + 1
    x[50:90] = x[50]  # ties and repeated vectors
    label = np.where(rng.random(count) < 0.5, 1, rng.integers(0, 4, count))  # one label holds more than half
    return [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True))]


def brute(rows, positives=5, negatives=3):
    rows = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows]
    out = []
    for a, label, v in rows:
        if a % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i, c) for i, c, w in rows if i != a and len(w) == len(v)]
        near = sorted((s, i) for s, i, c in scores if c == label)[:positives]
        other = sorted((s, i) for s, i, c in scores if c != label)
        for s, p in near:
            fits = [(n, i) for n, i in other if 50 * -s <= 100 * -n <= 95 * -s]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fits[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"block_rows": 13, "anchor_rows": 2}])
def test_hard_negatives_equal_brute_force(spark, options):
    rows = vectors() + ALONE
    found = negatives.hard_negatives(table(spark, rows + ODD), **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 50


def test_no_rows_and_one_label(spark):
    assert negatives.hard_negatives(table(spark, vectors()).where("false")).count() == 0
    assert negatives.hard_negatives(table(spark, ODD)).count() == 0
    assert negatives.hard_negatives(table(spark, [(i, 7, v) for i, _, v in vectors(120)])).count() == 0


def test_a_repeated_row_counts_each_time_and_asks_once(spark):
    rows = [(0, 1, [1.0]), (0, 1, [1.0]), (1, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.75]), (2, 2, [0.75])]
    found = negatives.hard_negatives(table(spark, rows)).collect()
    one = 256 * 256
    want = [(0, 1, r, 2, one, one * 3 // 4) for r in (1, 1, 2, 2)]
    assert sorted(tuple(r) for r in found) == sorted(want)


@pytest.mark.parametrize("low,high", [(-148, 148), (0, 1), (-5, -3), (-(2**20), 2**20), (-(2**40), 2**40), (10**15, 10**15 + 3)])
def test_packed_products_are_exact(low, high):
    rng = np.random.default_rng(2)
    rows, anchors = rng.integers(low, high, (37, 5), endpoint=True), rng.integers(low, high, (11, 5), endpoint=True)
    packed = negatives.Packed(rows, int(anchors.min()), int(anchors.max()))
    assert packed.fields > 1
    exact = anchors.astype(object) @ rows.astype(object).T
    assert packed.products(anchors).tolist() == [[min(max(x, -(2**63)), 2**63 - 1) for x in line] for line in exact.tolist()]
