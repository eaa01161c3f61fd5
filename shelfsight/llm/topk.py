"""Exact inner-product search over integer vectors, by norm buckets.

Vectors are grouped by length, in steps of a quarter of a power of two, and a
length class is dealt by hash of the id into buckets of about ``bucket_rows``
rows, so copies of one vector spread out. A task meets a block of queries and a
run of buckets, the longest vectors first. For a query whose k-th score so far
is s, a bucket whose greatest length is l can only help above the local cosine
threshold s / (|q| l): if that exceeds 1 the bucket is skipped; if it is high,
the query's largest coordinates bound those of a helpful vector (coordinate
pruning); else the bucket is read as far as its lengths reach (length pruning).
What is left is verified by exact integer products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import durable
from shelfsight.llm.vectors import best, matrix, numbers, valid

K = 5
BUCKET_ROWS = 1024
RUN_BUCKETS = 8
QUERY_ROWS = 8192
STEPS = 4  # Length classes per power of two.
FOCUS = 4  # Coordinates that coordinate pruning looks at.
HIGH = 0.4  # Local cosine threshold from which coordinates prune better than lengths.


class Bucket:
    """Vectors of like length, the longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        order = np.lexsort((ids, -length))
        self.ids, self.vectors, self.length = ids[order], vectors[order], length[order]
        self.unit = (self.vectors / np.maximum(self.length, 1e-300)[:, None]).T.copy()
        self.most = float(length.max(initial=0.0))
        # Products below 2^53 are exact as doubles, which multiply faster.
        self.fast = self.vectors.astype(float)

    def could_reach(self, q: np.ndarray, size: float, least: float) -> np.ndarray | slice:
        """Rows whose product with q (of length ``size``) can reach ``least``; a superset, never less."""
        if least <= 0 or size == 0:
            return slice(None) if least <= 0 else slice(0)
        if size * self.most * (1 + 1e-9) < least:
            return slice(0)
        cosine = min(1.0, least / (size * self.most) - 1e-9)
        if cosine < HIGH:
            return slice(int(np.searchsorted(-self.length, -least / size * (1 - 1e-9), side="right")))
        angle = np.arccos(cosine)
        keep = None
        for f in np.argsort(-np.abs(q), kind="stable")[:FOCUS]:
            own = np.arccos(np.clip(q[f] / size, -1, 1))
            low, high = np.cos(min(np.pi, own + angle)) - 1e-9, np.cos(max(0.0, own - angle)) + 1e-9
            inside = (self.unit[f] >= low) & (self.unit[f] <= high)
            keep = inside if keep is None else keep & inside
        return np.flatnonzero(keep)

    def products(self, q: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        if np.abs(q.astype(float)).max(initial=0) * len(q) * np.abs(self.fast).max(initial=0) < 2**53:
            return (self.fast[rows] @ q.astype(float)).astype(np.int64)
        exact = self.vectors[rows].astype(object) @ q.astype(object)
        return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in exact], dtype=np.int64)


def searched(queries: tuple[np.ndarray, np.ndarray], buckets: list[Bucket], k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best of all buckets for each query, ties to the smaller id."""
    out = []
    buckets = sorted(buckets, key=lambda b: -b.most)
    for qid, q in zip(*queries, strict=True):
        size = float(np.sqrt((q.astype(float) ** 2).sum()))
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for bucket in buckets:
            least = float(scores[k - 1]) if len(scores) == k else -np.inf
            rows = bucket.could_reach(q, size, least)
            near = bucket.ids[rows]
            if not len(near):
                continue
            product = bucket.products(q, rows)
            helps = (product >= least) & (near != qid)
            ids, scores = np.r_[ids, near[helps]], np.r_[scores, product[helps]]
            if len(scores) > 8 * k:
                # Only what reaches the k-th score can stay.
                some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                ids, scores = ids[some], scores[some]
            order = np.lexsort((ids, ~scores))[:k]
            ids, scores = ids[order], scores[order]
        out += [(int(qid), int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
    return out


def top_products(
    vectors: DataFrame,
    is_query: str = "vec_id % 50 = 0",
    k: int = K,
    scale: int = 256,
    bucket_rows: int = BUCKET_ROWS,
    run_buckets: int = RUN_BUCKETS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer products of each query.

    ``vectors`` has vec_id and embedding; a component x counts as floor(scale *
    x). Queries are the rows for which ``is_query`` holds; candidates are all
    rows with another id. Rows without an id, NULL or empty vectors and those
    with a NULL or non-finite component take no part, and only vectors with the
    same number of components meet. Ties go to the smaller id; a repeated row
    counts each time, as a query once. A product beyond 64 bits is held at the
    limit. Other columns are ignored. No row gives no row.
    """
    ints = valid(vectors).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v"), F.size("embedding").alias("dims")
    )
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    step = F.when(length > 0, F.floor(F.log2(length) * STEPS)).otherwise(-1)
    ints = durable(ints.withColumn("step", step.cast("long")))

    # Lengths take a bounded number of steps, so this is a small table.
    steps = ints.groupBy("dims", "step").agg(F.count("*").alias("n")).collect()
    first, run, plan = 0, 0, []
    for r in sorted(steps, key=lambda r: (r.dims, -r.step)):
        buckets = -(-r.n // bucket_rows)
        plan.append((r.dims, r.step, first, buckets))
        first += buckets
    spark = vectors.sparkSession
    named = spark.createDataFrame(plan or [(-1, 0, 0, 1)], "dims int, step long, first long, buckets long")
    placed = ints.join(named, ["dims", "step"]).withColumn(
        "bucket", F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("buckets"))
    )
    asked = ints.where(is_query).dropDuplicates(["vec_id", "v"])
    parts = -(-asked.count() // query_rows) or 1
    runs = named.groupBy("dims").agg(
        F.floor(F.min("first") / run_buckets).alias("low"),
        F.floor(F.max(F.col("first") + F.col("buckets") - 1) / run_buckets).alias("high"),
    )
    left = (
        asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
        .join(runs, "dims")
        .withColumn("run", F.explode(F.sequence("low", "high")))
        .select("dims", "part", "run", "vec_id", "v")
        .toDF("dims", "part", "run", "vec_id", "v")
    )
    right = placed.withColumn("part", numbers(F.lit(parts))).withColumn("run", F.floor(F.col("bucket") / run_buckets))
    right = right.select("dims", "part", "run", "bucket", "vec_id", "v").toDF("dims", "part", "run", "bucket", "vec_id", "v")

    def meet(query: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if query.num_rows and rows.num_rows:
            ids, v = rows["vec_id"].to_numpy(), matrix(rows["v"], np.int64)
            bucket = rows["bucket"].to_numpy()
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            buckets = [Bucket(ids[at], v[at]) for at in np.split(order, cuts)]
            found = searched((query["vec_id"].to_numpy(), matrix(query["v"], np.int64)), buckets, k)
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    keys = ["dims", "part", "run"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    return best(found, k)
