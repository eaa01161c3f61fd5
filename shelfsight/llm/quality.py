"""Document quality by Bradley-Terry ranking.

Each preference pair joins a good and a bad labelled document; the chance that
the good one wins is the logistic function of the difference of two scores,
and a score is linear in the features of a text. The weights minimise the
logistic loss of the feature differences over all pairs of all labelled
documents. The score quantile at the share of bad documents becomes the
threshold: scores are shifted so that it is ``cut``.

Pairs are not written out. A Newton step sums the labelled rows by label and
narrow bins of their score, and all rows of two bins meet at their mean scores,
corrected for how the features change with the score inside a bin.
Features count characters, words and lines of the whole text and are computed
in one pass; the labelled rows stay distributed, the driver receives the sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import batches, small_batches, stored, text_of
from shelfsight.operators.common import quantiles_of

CUT = 0.3
RIDGE = 1e-3
# Bins of scores, and how many of them share a sum of squares.
BINS, GROUPED = 2048, 64
STEPS = 25
# Rounding does not keep a row that lies on the threshold below it.
TIE = 1e-9
NAMES = (
    "log_words", "mean_word", "letters", "upper", "digits", "blanks", "symbols", "marks", "pipes", "quotes",
    "distinct_words", "line_repeats", "log_lines", "words_per_line", "upper_words", "odd_endings",
    "most_common", "mid_symbols", "short_words", "ended_lines",
)


def measures(text: str) -> list[float]:
    """The features of a text, in the order of NAMES; an empty text has only zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n, size = len(codes), len(words)
    low = np.bincount(np.minimum(codes, 127), minlength=128)
    upper = low[65:91].sum()
    letters = upper + low[97:123].sum() + (codes >= 0xAA).sum()
    digits, blanks = low[48:58].sum(), low[32] + low[9:14].sum()
    symbols = low[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]].sum()
    marks = low[33] + low[63]
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=size)
    ends = [w[-1] for w in words]
    return [
        float(np.log1p(size)),
        float(np.log(lengths.mean())),
        letters / n,
        upper / max(letters, 1),
        digits / n,
        blanks / n,
        symbols / n,
        marks / n,
        low[124] / size,
        low[34] / size,
        len(counts) / size**0.8,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(len(lines))),
        float(np.log1p(size / len(lines))),
        sum(map(str.isupper, words)) / size,
        sum(not e.isalnum() and e not in ".,;:" for e in ends) / size,
        max(counts.values()) / size,
        sum(e in "*#$%&" for e in ends) / size,
        float((lengths <= 2).mean()),
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines),
    ]


class PairSums:
    """Sums of scaled features by label (good, bad) and bin of the score under ``weights``, enough for a step over all pairs.

    Scaled features lie within 8 of 0, which bounds the scores, so that every
    task knows the bins. Their width is 16 / BINS of the weights' absolute sum.
    """

    def __init__(self, weights: np.ndarray):
        size = len(weights)
        self.weights, self.top = weights, 8 * np.abs(weights).sum() + 1e-9
        self.n = np.zeros((2, BINS))
        # Features, then features times the score.
        self.z = np.zeros((2, BINS, 2 * size))
        self.squares = np.zeros((2, BINS // GROUPED, size, size))

    def add(self, z: np.ndarray, times: np.ndarray) -> None:
        """Rows of scaled features, and how often each counts as good and as bad."""
        score = z @ self.weights
        place = np.clip((score + self.top) / (2 * self.top) * BINS, 0, BINS - 1).astype(np.int64)
        for label in (0, 1):
            held = np.flatnonzero(times[:, label])
            held = held[np.argsort(place[held], kind="stable")]
            if not len(held):
                continue
            at, n = place[held], times[held, label].astype(float)
            weighted = z[held] * n[:, None]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            self.n[label, at[first]] += np.add.reduceat(n, first)
            self.z[label, at[first]] += np.add.reduceat(np.c_[weighted, weighted * score[held, None]], first)
            group = at // GROUPED
            edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                self.squares[label, group[a]] += z[held[a:b]].T @ weighted[a:b]

    def rows(self) -> Iterator[tuple[int, int, list[float]]]:
        """(kind, place, sums) of all that is not empty."""
        for label in (0, 1):
            found = np.flatnonzero(self.n[label])
            for at in found.tolist():
                yield label, at, [self.n[label, at], *self.z[label, at]]
            for group in np.unique(found // GROUPED).tolist():
                yield 2 + label, group, self.squares[label, group].ravel()

    def take(self, kind: int, at: int, sums: np.ndarray) -> None:
        """Add what ``rows`` gave elsewhere."""
        if kind < 2:
            self.n[kind, at] += sums[0]
            self.z[kind, at] += sums[1:]
        else:
            self.squares[kind - 2, at] += sums.reshape(self.squares.shape[2:])

    def step(self, ridge: float) -> np.ndarray:
        """The Newton step on the mean logistic loss of all pairs, with a ridge."""
        held = [np.flatnonzero(n) for n in self.n]
        n = [self.n[k][held[k]] for k in (0, 1)]
        mean, by_score = zip(*[np.hsplit(self.z[k][held[k]] / n[k][:, None], 2) for k in (0, 1)], strict=True)
        pairs = np.outer(*n) / (n[0].sum() * n[1].sum())
        loses = 1 / (1 + np.exp(np.clip((mean[0] @ self.weights)[:, None] - mean[1] @ self.weights, -30, 30)))
        by_loss, by_curve = pairs * loses, pairs * loses * (1 - loses)
        gradient = by_loss.sum(axis=0) @ mean[1] - by_loss.sum(axis=1) @ mean[0] + ridge * self.weights
        between = mean[0].T @ by_curve @ mean[1]
        curve = ridge * np.eye(len(self.weights)) - between - between.T
        for k in (0, 1):
            share = by_curve.sum(axis=1 - k)
            curve += (mean[k] * share[:, None]).T @ mean[k]
            gradient += share @ (by_score[k] - mean[k] * (mean[k] @ self.weights)[:, None])
            # What rows differ by inside a bin, at the mean curvature of a group of bins.
            for group in np.unique(held[k] // GROUPED):
                here = held[k] // GROUPED == group
                inside = self.squares[k, group] - (mean[k][here] * n[k][here, None]).T @ mean[k][here]
                curve += inside * share[here].sum() / n[k][here].sum()
        return np.linalg.solve(curve, gradient)


def fitted(sums: Callable[[np.ndarray], PairSums], ridge: float = RIDGE) -> np.ndarray:
    """The weights of least loss over all pairs; ``sums`` gives the sums under some weights."""
    weights = np.zeros(len(NAMES))
    for _ in range(STEPS):
        step = sums(weights).step(ridge)
        weights = weights - step
        if np.abs(step).max() <= 1e-4 * (1 + np.abs(weights).max()):
            break
    return weights


class Ranking:
    """Weights of the features, from preference pairs.

    Of arrays: all pairs of a good and a bad row, or ``pairs`` drawn ones. ``trained`` gives that of tables.
    """

    def __init__(
        self, x: np.ndarray, y: np.ndarray, pairs: int | None = None, cut: float = CUT, ridge: float = RIDGE, seed: int = 7
    ):
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            self._one_sided(len(bad) > 0, cut)
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._scaled(x)
        if pairs is None:

            def sums(weights: np.ndarray) -> PairSums:
                found = PairSums(weights)
                found.add(z, np.stack([y == 1, y == 0], axis=1))
                return found

            self.weights = fitted(sums, ridge)
        else:
            rng = np.random.default_rng(seed)
            self.weights = self._fitted(z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)], ridge)
        self._cut_at(np.quantile(z @ self.weights, len(bad) / len(y)), cut)

    @classmethod
    def of(cls, mean: np.ndarray, scale: np.ndarray) -> Ranking:
        """A ranking whose weights are still to be found."""
        new = cls.__new__(cls)
        new.mean, new.scale = mean, scale
        return new

    def _one_sided(self, bad: bool, cut: float) -> None:
        """One kind of label teaches no order: everything is on that side."""
        self.mean, self.scale, self.weights = np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(len(NAMES))
        self.shift = np.log(cut / (1 - cut)) + (-1.0 if bad else 1.0)

    def _cut_at(self, threshold: float, cut: float) -> None:
        self.shift = np.log(cut / (1 - cut)) - threshold + TIE

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    @staticmethod
    def _fitted(d: np.ndarray, ridge: float) -> np.ndarray:
        """Newton steps on the mean logistic loss of the differences, with a ridge."""
        w = np.zeros(d.shape[1])
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            gradient = -(d * (1 - p)[:, None]).mean(axis=0) + ridge * w
            curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
            w -= np.linalg.solve(curve, gradient)
        return w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._scaled(x) @ self.weights + self.shift, -30, 30)))


def _measured(df: DataFrame) -> DataFrame:
    """The columns besides the text, and x: the mean features of the rows that agree in them."""
    kept = [c for c in df.columns if c != "text"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            x = [measures(t) for t in batch.column("text").to_pylist()]
            columns = [*(batch.column(c) for c in kept), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "x"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    rows = df.select("text", *kept).mapInArrow(run, f"{schema}, x array<double>")
    return rows.groupBy(*kept).agg(F.array(*[F.avg(F.col("x")[i]) for i in range(len(NAMES))]).alias("x"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The features of rows, and how often each counts as good and as bad."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    return x, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "bad")], axis=1)


def _pair_sums(rows: DataFrame, ranking: Ranking, weights: np.ndarray) -> PairSums:
    """The sums over ``rows`` (good, bad, x); no task and not the driver receives more than the bins hold."""

    def given(sums: PairSums) -> Iterator[pa.RecordBatch]:
        held = list(sums.rows())
        if held:
            kind, at, values = zip(*held, strict=True)
            arrays = [pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "place", "sums"])

    def summed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums(weights)
        for batch in batches(frames):
            x, times = _arrays(batch)
            sums.add(ranking._scaled(x), times)
        yield from given(sums)

    def merged(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums(weights)
        for batch in batches(frames):
            for kind, at, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.take(kind, at, np.array(values))
        yield from given(sums)

    schema = "kind int, place int, sums array<double>"
    parts = rows.mapInArrow(summed, schema).repartition("kind", "place").mapInArrow(merged, schema)
    found = PairSums(weights)
    for r in sorted(parts.collect()):
        found.take(r.kind, r.place, np.array(r.sums))
    return found


def _threshold(rows: DataFrame, ranking: Ranking, share: float) -> float:
    """The exact quantile of the rows' scores."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            x, times = _arrays(batch)
            score = ranking._scaled(x) @ ranking.weights
            yield pa.RecordBatch.from_arrays([pa.array(score), pa.array(times.sum(axis=1))], ["value", "times"])

    scores = rows.mapInArrow(run, "value double, times long").groupBy("value").agg(F.sum("times").alias("n"))
    return quantiles_of(scores, {"threshold": share}, split=True).first().threshold


def trained(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> Ranking:
    """A ranking from ``documents`` (doc_id, text) and ``labels`` (doc_id, quality), of all labels and all their pairs.

    Labels other than 0 and 1 or without an id are ignored; a document with
    several labels counts for each. The rows of one doc_id count as one, of
    their mean features, so that a label weighs the same however often its id
    comes. The features of labelled rows are kept in the folder of
    ``spark.checkpoint.dir``; the driver receives their sums only.
    """
    small_batches(documents.sparkSession)
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id")
    known = known.agg(*[F.count_if(F.col("quality") == k).alias(n) for n, k in (("good", 1), ("bad", 0))])
    texts = documents.where("doc_id is not null").select("doc_id", text_of("text").alias("text"))
    # The features meet the labels, so that no text crosses the network.
    rows = stored(_measured(texts).join(known, "doc_id").select("good", "bad", "x"))
    times = F.col("good") + F.col("bad")
    x = [F.col("x")[i] for i in range(len(NAMES))]
    good, bad, *sums = rows.agg(F.sum("good"), F.sum("bad"), *[F.sum(times * c) for c in x]).first()
    if not good or not bad:
        ranking = Ranking.of(np.zeros(0), np.zeros(0))
        ranking._one_sided(bool(bad), cut)
        return ranking
    mean = np.array(sums) / (good + bad)
    squares = rows.agg(*[F.sum(times * (c - float(m)) ** 2) for c, m in zip(x, mean, strict=True)]).first()
    ranking = Ranking.of(mean, np.sqrt(np.array(squares) / (good + bad)) + 1e-9)
    ranking.weights = fitted(lambda weights: _pair_sums(rows, ranking, weights))
    ranking._cut_at(_threshold(rows, ranking, bad / (good + bad)), cut)
    return ranking


def scored(documents: DataFrame, ranking: Ranking, cut: float = CUT) -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 if the score reaches ``cut``).

    Only the text is used, all of it, however long. A NULL text is an empty one;
    empty texts get the score of a text whose features are all zero. Repeated
    rows score alike, and an empty table gives an empty one. Columns of these
    two names are replaced, others pass through. The session's Arrow batches are
    made smaller for good.
    """
    spark = documents.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(ranking)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([measures(t) for t in texts.to_pylist()]).reshape(-1, len(NAMES))
        return pa.array(held.value.score(x))

    out = documents.withColumn("score", score(text_of("text")))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
