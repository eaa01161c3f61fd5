from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from samples import odd_rows, said

from shelfsight.llm import quality


def labelled(spark, count=120):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(count):
        good = i % 2
        text = ". ".join(said(rng, 12).capitalize() for _ in range(6)) + "." if good else "BUY *** " + "win $$ now ### " * 20
        rows.append((i, text))
        labels.append((i, good))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_labels_are_told_apart(spark):
    docs, labels = labelled(spark)
    ranking = quality.trained(docs, labels.where("doc_id % 5 != 0"))
    found = quality.scored(docs.where("doc_id % 5 = 0"), ranking).collect()
    assert all(r.predicted == r.doc_id % 2 for r in found)
    assert all(0 <= r.score <= 1 and (r.score >= quality.CUT) == (r.predicted == 1) for r in found)


def test_pairs_decide_the_weights_not_the_share_of_labels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.NAMES)))
    y = (x[:, 0] - x[:, 3] > 1).astype(int)
    ranking = quality.Ranking(x, y)
    order = ranking.score(x)
    good, bad = order[y == 1], order[y == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.99
    # The threshold is a quantile: as many are above the cut as labels are 1.
    assert abs(int((order >= quality.CUT).sum()) - int(y.sum())) <= 1


def test_odd_labels_and_rows(spark, documents):
    docs = documents(odd_rows())
    for table in ([], [(1, 1)], [(1, 0), (5, 1), (5, 0), (None, 1), (2, 7), (3, None)]):
        labels = spark.createDataFrame(table, "doc_id long, quality int")
        found = quality.scored(docs, quality.trained(docs, labels))
        rows = found.collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if not r.text}) == 1
    assert quality.scored(docs.where("false"), quality.trained(docs.where("false"), labels)).count() == 0


def test_a_repeated_id_weighs_as_much_as_any(spark):
    docs, labels = labelled(spark)
    labels = labels.union(spark.createDataFrame([(500, 0), (500, 0)], "doc_id long, quality int"))
    odd = spark.createDataFrame([(500, "A clean text with a label that does not fit it. It ends well.")], docs.schema)
    once = quality.trained(docs.union(odd), labels)
    often = quality.trained(docs.union(odd.crossJoin(spark.range(3000)).drop("id")), labels)
    assert np.allclose(once.weights, often.weights, atol=1e-4) and np.isclose(once.shift, often.shift, atol=1e-4)
    joined = docs.union(odd).union(odd).join(labels.groupBy("doc_id", "quality").agg({"*": "count"}), "doc_id")
    assert quality._measured(joined.withColumnRenamed("count(1)", "times")).count() == 121


def plain_measures(text):
    """The features by their names, letter by letter."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    if not words:
        return [0.0] * len(quality.NAMES)
    share = lambda of: sum(map(of, text)) / len(text)
    upper = sum("A" <= c <= "Z" for c in text)
    letters = upper + sum("a" <= c <= "z" or ord(c) >= 0xAA for c in text)
    counts = Counter(words)
    mean = sum(map(len, words)) / len(words)
    named = {
        "log_words": math.log(1 + len(words)), "mean_word": math.log(mean), "letters": letters / len(text),
        "upper": upper / max(letters, 1), "digits": share(lambda c: "0" <= c <= "9"), "blanks": share(lambda c: c in " \t\n\v\f\r"),
        "symbols": share(lambda c: c in "#$%&*+<=>@[\\]^_`{}~"), "marks": share(lambda c: c in "!?"),
        "pipes": text.count("|") / len(words), "quotes": text.count('"') / len(words), "distinct_words": len(counts) / len(words) ** 0.8,
        "line_repeats": 1 - len(set(lines)) / len(lines), "log_lines": math.log(1 + len(lines)),
        "words_per_line": math.log(1 + len(words) / len(lines)), "upper_words": sum(w.isupper() for w in words) / len(words),
        "odd_endings": sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / len(words),
        "most_common": max(counts.values()) / len(words), "mid_symbols": sum(w[-1] in "*#$%&" for w in words) / len(words),
        "short_words": sum(len(w) <= 2 for w in words) / len(words),
        "ended_lines": sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines),
    }
    return [named[n] for n in quality.NAMES]


def test_measures_equal_counting_letter_by_letter():
    rng = random.Random(2)
    letters = "aB9 .\n\t|\"#!$é中?_~x,;\x0b"
    texts = ["", " \n", "one", "".join(rng.choices(letters, k=3000)), said(rng, 5000)]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(200)]
    for text in texts:
        assert np.allclose(quality.measures(text), plain_measures(text), atol=1e-12), text


def test_weights_are_the_least_of_the_pairwise_loss_and_scores_follow_from_them():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, len(quality.NAMES))) * rng.uniform(0.1, 9, len(quality.NAMES))
    y = (x[:, 1] + rng.normal(size=300) > 0).astype(int)
    ranking = quality.Ranking(x, y, pairs=2000, seed=5)
    # The same pairs, drawn again.
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), -8, 8)
    draw = np.random.default_rng(5)
    d = z[draw.choice(np.flatnonzero(y == 1), 2000)] - z[draw.choice(np.flatnonzero(y == 0), 2000)]

    def loss(w):
        return np.log1p(np.exp(-d @ w)).mean() + 1e-3 / 2 * w @ w

    for j in range(len(quality.NAMES)):
        for step in (-1e-3, 1e-3):
            moved = ranking.weights.copy()
            moved[j] += step
            assert loss(moved) >= loss(ranking.weights)
    own = z @ ranking.weights
    cut = np.quantile(own, (y == 0).mean())
    want = 1 / (1 + np.exp(-(own - cut + math.log(0.3 / 0.7))))
    assert np.allclose(ranking.score(x), want)


def noisy(count):
    """Features, and labels that follow one of them with much noise."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(count, len(quality.NAMES))) * rng.uniform(0.1, 9, len(quality.NAMES))
    return x, (x[:, 1] + 6 * rng.normal(size=count) > 1).astype(int)


def test_all_pairs_count():
    """The weights are where the loss of every pair, written out, is least."""
    x, y = noisy(300)
    ranking = quality.Ranking(x, y)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), -8, 8)
    good, bad = z[y == 1], z[y == 0]
    d = (good[:, None] - bad[None]).reshape(-1, len(quality.NAMES))
    want = quality.Ranking._fitted(d, quality.RIDGE)
    assert np.allclose(ranking.weights, want, atol=1e-4)
    assert np.isclose(ranking.shift, math.log(0.3 / 0.7) - np.quantile(z @ ranking.weights, (y == 0).mean()))


def test_all_labels_count_however_many(spark, monkeypatch):
    """30,000 labels, each of them in the mean, the weights and the threshold."""
    x, y = noisy(30_000)
    values = x.tolist()
    # Labels that come twice count twice, also those of both kinds.
    twice, other = np.arange(0, 30_000, 7), np.arange(0, 30_000, 11)
    table = [*enumerate(y.tolist()), *((int(i), int(y[i])) for i in twice), *((int(i), 1 - int(y[i])) for i in other)]
    docs = spark.range(30_000).selectExpr("id AS doc_id", "string(id) AS text")
    monkeypatch.setattr(quality, "_measured", lambda df: measured(df, values))
    found = quality.trained(docs, spark.createDataFrame(table, "doc_id long, quality int"))
    rows = np.r_[np.arange(30_000), twice, other]
    want = quality.Ranking(x[rows], np.r_[y, y[twice], 1 - y[other]])
    assert np.allclose(found.mean, want.mean) and np.allclose(found.scale, want.scale)
    assert np.allclose(found.weights, want.weights, atol=1e-6) and np.isclose(found.shift, want.shift, atol=1e-6)
    assert np.allclose(found.score(x), want.score(x), atol=1e-6)


def measured(df, values):
    """(doc_id, x) of rows whose text is their number."""
    table = df.sparkSession.createDataFrame([*enumerate(values)], "doc_id long, x array<double>")
    return df.select("doc_id").join(table, "doc_id")
