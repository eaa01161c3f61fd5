"""Language of a document from several kinds of evidence, by Bayes' rule.

* Text: likelihood of its letter trigrams (hashed into a fixed number of cells)
  under one smoothed model per language. The models are counted over all
  documents by the language that they declare.
* Declaration: how often documents, whose text looks like a language, declare each.
* Address suffix: how often such documents have the suffix.
* Host: share of each language among the host's documents by text, smoothed
  with the shares of its domain, and those with the shares of all documents.

The last three are grouped sums over all documents. A document without letters,
one whose trigrams are hardly likelier than chance under every language, and
one whose best language stays below ``least`` are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import U, batches, mixed, small_batches, stored

LANGUAGES = ("en", "fr", "de", "es")
CELLS = 1 << 14
ALPHA = 0.5
HOST_WEIGHT = 20.0
DOMAIN_WEIGHT = 50.0
EVIDENCE = 60  # A text counts as this many independent trigrams at most.
LEAST = 0.5
CHANCE = 0.4  # This much likelier than chance, per trigram, is language; short texts need less.
SLACK = 6.0


def cells(text: str) -> np.ndarray:
    """Cells of the trigrams around each letter; everything else is one kind of gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letters = (codes - 97 < 26) | (codes >= 0xAA)
    codes = np.r_[0, np.where(letters, codes, 0), 0].astype(U)
    at = np.flatnonzero(letters)
    keys = (codes[at] << U(42)) | (codes[at + 1] << U(21)) | codes[at + 2]
    return (mixed(keys, 3) >> U(50)).astype(np.int64)


class Models:
    """Log-probability of each cell in each language."""

    def __init__(self, counts: np.ndarray):
        total = counts.sum(axis=1, keepdims=True)
        self.log = np.log((counts + ALPHA) / (total + ALPHA * counts.shape[1])).T.copy()
        self.known = total[:, 0] > 0

    def evidence(self, text: str) -> tuple[list[float], float]:
        """Log-likelihoods up to a constant, tempered; the best mean over chance with its slack (-99 without letters)."""
        found = cells(text)
        if not len(found):
            return [0.0] * self.log.shape[1], -99.0
        mean = self.log[found].mean(axis=0) + np.log(CELLS)
        return (mean * min(len(found), EVIDENCE)).tolist(), float(mean.max()) + SLACK / len(found) ** 0.5


def _counted(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Trigram counts by declared language, over all rows; what reaches the driver has a fixed size."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), CELLS), dtype=np.int64)
        for batch in batches(frames):
            for text, said in zip(batch.column("_text").to_pylist(), batch.column("_said").to_pylist(), strict=True):
                counts[said] += np.bincount(cells(text), minlength=CELLS)
        for k, own in enumerate(counts):
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["k", "cell", "n"]
            )

    said = rows.where(F.col("_said").isNotNull()).select("_text", "_said")
    sums = said.mapInArrow(run, "k int, cell int, n long").groupBy("k", "cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), CELLS))
    for part in sums.toArrow().to_batches():
        k, cell, n = (part.column(i).to_numpy() for i in range(3))
        counts[k, cell] = n
    return counts


def _shares(counts: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n): the counts of each language as an array."""
    return counts.groupBy(key).agg(F.array(*[F.sum(F.when(F.col("_looks") == k, F.col("n")).otherwise(0)) for k in range(size)]).alias("n"))


def _smoothed(n: Column, prior: Column, weight: float) -> Column:
    total = F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.zip_with(n, prior, lambda x, p: (x + weight * p) / (total + weight))


RESERVED = {
    "_text", "_code", "_host", "_domain", "_suffix", "_said", "_found", "_looks", "_up", "_prior", "_declares", "_ends", "_scores",
}


def identified(
    documents: DataFrame,
    text: Column,
    declared: Column,
    host: Column,
    suffix: Column | None = None,
    languages: tuple[str, ...] = LANGUAGES,
    least: float = LEAST,
) -> DataFrame:
    """``documents`` with ``language`` (NULL if rejected), ``confidence`` and ``accepted``.

    ``text``, ``declared``, ``host`` and ``suffix`` (by default the host's last
    label) are expressions over its columns, any of which may be NULL: a NULL
    text is empty and rejected, NULL evidence tells nothing. A declared language
    counts by its first two letters; one not in ``languages`` is a value like
    any other. Equal scores go to the language listed first. Repeated rows get
    equal results; whole texts are read, however long; an empty table gives an
    empty one. Other columns pass through, but for ``language``, ``confidence``
    and ``accepted``, which are replaced, and names in RESERVED, which are refused
    with a ValueError. The session's Arrow batches are made smaller for good.
    """
    taken = RESERVED.intersection(documents.columns)
    if taken:
        raise ValueError(f"columns of the documents have reserved names: {sorted(taken)}")
    spark = documents.sparkSession
    small_batches(spark)
    size = len(languages)
    code = F.lower(F.substring(declared, 1, 2))
    label = F.lower(F.element_at(F.split(host, "\\."), -1))
    suffix = F.when(host.contains("."), label) if suffix is None else suffix
    domain = F.regexp_extract(F.lower(host), r"([^.]+\.[^.]+)$", 1)
    rows = documents.withColumns(
        {
            "_text": F.coalesce(text, F.lit("")),
            "_code": F.coalesce(code, F.lit("")),
            "_host": F.coalesce(F.lower(host), F.lit("")),
            "_domain": F.coalesce(domain, F.lit("")),
            "_suffix": F.coalesce(suffix, F.lit("")),
        }
    )
    said = F.lit(None).cast("int")
    for k, name in enumerate(languages):
        said = F.when(F.col("_code") == name, k).otherwise(said)
    models = spark.sparkContext.broadcast(Models(_counted(rows.withColumn("_said", said), languages)))

    @F.arrow_udf("struct<like:array<double>,over:double>")
    def evidence(texts: pa.Array) -> pa.Array:
        found = [models.value.evidence(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.list_(pa.float64())), pa.array([f[1] for f in found], pa.float64())], ["like", "over"]
        )

    keys = ["_code", "_host", "_domain", "_suffix"]
    rows = rows.withColumn("_found", evidence("_text"))
    best = F.array_position("_found.like", F.array_max("_found.like")).cast("int") - 1
    counts = stored(
        rows.where(F.col("_found.over") >= CHANCE).select(*keys, best.alias("_looks")).groupBy(*keys, "_looks").agg(F.count("*").alias("n"))
    )
    every = counts.agg(*[F.sum(F.when(F.col("_looks") == k, F.col("n")).otherwise(0)) for k in range(size)]).first()
    whole = sum(x or 0 for x in every)
    overall = [((x or 0) + 1.0) / (whole + size) for x in every]
    prior = F.array(*[F.lit(p) for p in overall])

    hosts = counts.select("_host", "_domain").distinct()
    hosts = hosts.join(_shares(counts, "_host", size), "_host")
    domains = _shares(counts.where("_domain != ''"), "_domain", size).withColumn("_up", _smoothed(F.col("n"), prior, DOMAIN_WEIGHT))
    hosts = hosts.join(domains.select("_domain", "_up"), "_domain", "left")
    hosts = hosts.select("_host", _smoothed(F.col("n"), F.coalesce("_up", prior), HOST_WEIGHT).alias("_prior"))

    def likelihood(key: str, to: str) -> DataFrame:
        """For each value of key, its share among the documents of each language."""
        shares = _shares(counts.where(F.col(key) != ""), key, size)
        sums = F.array(*[F.lit(float(x or 0)) for x in every])
        return shares.select(key, F.zip_with("n", sums, lambda x, s: (x + 0.5) / (s + 50.0)).alias(to))

    def with_table(df: DataFrame, small: DataFrame, key: str) -> DataFrame:
        return df.join(stored(small), key, "left")

    flat = F.array(*[F.lit(1.0)] * size)
    rows = with_table(rows, hosts, "_host")
    rows = with_table(rows, likelihood("_code", "_declares"), "_code")
    rows = with_table(rows, likelihood("_suffix", "_ends"), "_suffix")
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.col("_found.like")[i]
        + F.log(F.coalesce("_prior", prior)[i])
        + F.log(F.coalesce("_declares", flat)[i])
        + F.log(F.coalesce("_ends", flat)[i]),
    )
    rows = rows.withColumn("_scores", scores)
    top = F.array_max("_scores")
    confidence = 1 / F.aggregate(F.col("_scores"), F.lit(0.0), lambda a, x: a + F.exp(x - top))
    name = F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("_scores", top).cast("int"))
    accepted = (F.col("_found.over") >= CHANCE) & (confidence >= least)
    kept = [F.col(c) for c in documents.columns if c not in ("language", "confidence", "accepted")]
    return rows.select(*kept, F.when(accepted, name).alias("language"), confidence.alias("confidence"), accepted.alias("accepted"))
