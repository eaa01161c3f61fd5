from __future__ import annotations

import math

import numpy as np
import pytest

from shelfsight.llm import neighbours, topk

ODD = [
    (None, [1.0, 2.0, 3.0, 4.0]),
    (1000, None),
    (1050, []),
    (1100, [1.0, None, 0.0, 0.0]),
    (1150, [1.0, float("nan"), 0.0, 0.0]),
    (1200, [float("inf"), 0.0, 0.0, 0.0]),
    (1250, [0.0, 0.0, 0.0, 0.0]),
    (1300, [1.0, 2.0]),
]


def table(spark, rows):
    rows = [(i, v, "x", 1, 2, "y") for i, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket string, cell int, dims int, part string")


def vectors(count=600, dims=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, dims)) * np.exp(rng.normal(size=(count, 1)))
    x[50:80] = x[50]  # ties and repeated vectors
    return [(i, v.tolist()) for i, v in enumerate(x)]


def best_products(rows, k=5):
    rows = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    out = []
    for q, a in rows:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 7, "run_buckets": 3, "query_rows": 2}])
def test_top_products_equal_brute_force(spark, options):
    rows = vectors() + [r for r in ODD if r[0] == 1250]
    found = topk.top_products(table(spark, vectors() + ODD[:-1]), **options)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == best_products(rows)


def test_top_products_of_few_rows(spark):
    rows = [(0, [1.0, 1.0]), (50, [2.0, -1.0]), (51, [-3.0, 0.0])]
    found = topk.top_products(table(spark, rows)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == best_products(rows)
    assert topk.top_products(table(spark, rows).where("false")).count() == 0
    assert topk.top_products(table(spark, [(50, [1.0])])).count() == 0


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / np.sqrt((a * a).sum() * (b * b).sum()))


def test_near_vectors_find_the_nearest(spark):
    rows = vectors(6000, 16, 2)
    known = dict(rows)
    found = neighbours.near_vectors(table(spark, rows + [r for r in ODD if r[0] not in known]))
    by_query = {}
    for r in found.collect():
        by_query.setdefault(r.query_id, []).append(r)
    assert sorted(by_query) == [i for i in range(0, 6000, 50)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, near in by_query.items():
        near.sort(key=lambda r: r.rank)
        assert [r.rank for r in near] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - cosine(known[q], known[r.vec_id])) < 1e-12 for r in near)
        assert [(-r.score, r.vec_id) for r in near] == sorted((-r.score, r.vec_id) for r in near)
        scores = x @ x[q]
        scores[q] = -2
        hits += sum(r.score >= np.sort(scores)[-5] - 1e-9 for r in near)
    assert hits / (5 * len(by_query)) >= 0.9


def test_near_vectors_are_exact_while_all_rows_are_ranked(spark):
    rows = vectors(300, 8, 3)
    found = neighbours.near_vectors(table(spark, rows)).collect()
    for q in range(0, 300, 50):
        exact = sorted((-round(cosine(rows[q][1], v), 12), i) for i, v in rows if i != q)[:5]
        got = sorted((r.rank, -round(r.score, 12), r.vec_id) for r in found if r.query_id == q)
        assert [(s, i) for _, s, i in got] == exact


def test_near_vectors_of_every_length_are_found(spark):
    rows = [(i, v) for i, v in vectors(300, 8, 3) if i % 3 < 2] + [(i, v[: 1 + i % 2]) for i, v in vectors(300, 8, 4) if i % 3 == 2]
    rows = [(i, v) for i, v in rows if any(v)]
    known = dict(rows)
    found = neighbours.near_vectors(table(spark, rows), sample_rows=12).collect()
    for q in range(0, 300, 50):
        near = [(-round(cosine(known[q], v), 12), i) for i, v in rows if i != q and len(v) == len(known[q])]
        got = sorted((r.rank, -round(r.score, 12)) for r in found if r.query_id == q)
        assert [s for _, s in got] == [s for s, _ in sorted(near)[:5]], q
    assert len({len(known[q]) for q in range(0, 300, 50)}) > 1


def test_near_vectors_of_odd_rows(spark):
    # Of the odd rows, two can take part, and they don't meet.
    assert neighbours.near_vectors(table(spark, ODD)).count() == 0
    assert neighbours.near_vectors(table(spark, ODD).where("false")).count() == 0
    same = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(200)]
    found = neighbours.near_vectors(table(spark, same + same)).collect()
    assert {r.query_id for r in found} == {0, 50, 100, 150}
    for q in (0, 50, 100, 150):
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [
            i for i in range(6) if i != q
        ][:5]
