"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are split into two halves, each quantised by ``centroids`` of its
own, fitted by k-means on at most ``sample_rows`` rows (least hash first). A row
lies in the cell of its pair of centroids, and every row is in the index. A
query walks the pairs by the sum of its distances to both centroids, with a
heap, until the cells walked hold the wanted share of rows. The sum at which it
stops is all that travels: a task knows from it which of its cells the query
has walked, and ranks their rows by exact cosine.

Of equal vectors only the k + 1 least ids can be in a result, so only they are
indexed. A cell that is still large is dealt by hash into blocks. Each number of
components has an index of its own, and only vectors of one number meet. A number
that no row of the sample has is so rare that all its rows lie in one cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.llm.common import durable, of_least_hash, partitions
from shelfsight.llm.vectors import best, matrix, numbers, valid

K = 5
SAMPLE_ROWS = 20_000
ROWS_PER_CENTROID = 32
MOST_CENTROIDS = 256
CANDIDATES = 0.28  # Nearly structureless vectors need this much for a recall above 0.9.
BLOCK_ROWS = 4096
BUNDLE_ROWS = 16_384
QUERY_ROWS = 8192


def kmeans(x: np.ndarray, count: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of x; fewer where x has fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:count]]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(x, centres).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, rows: dict[int, int], wanted: int) -> float:
    """Walk cells (i * len(second) + j) by the sum of both distances until they hold ``wanted`` rows: the last sum."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    p, q = np.sort(first).tolist(), np.sort(second).tolist()
    # Row i of the table enters when its left neighbour leaves; each row has one pair waiting.
    heap, held, total = [(p[0] + q[0], 0, 0)], 0, 0.0
    while heap:
        total, i, j = heapq.heappop(heap)
        held += rows.get(a[i] * len(b) + b[j], 0)
        if held >= wanted:
            break
        if j + 1 < len(b):
            heapq.heappush(heap, (p[i] + q[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (p[i + 1] + q[0], i + 1, 0))
    return total


class MultiIndex:
    """The centroids of both halves, for vectors of ``dims`` components."""

    def __init__(self, sample: np.ndarray, count: int):
        self.half = sample.shape[1] // 2
        unit = self.unit(sample)
        self.first, self.second = kmeans(unit[:, : self.half], count), kmeans(unit[:, self.half :], count)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def cell(self, x: np.ndarray) -> np.ndarray:
        unit = self.unit(x)
        return nearest(unit[:, : self.half], self.first) * len(self.second) + nearest(unit[:, self.half :], self.second)

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of each row to the first and to the second centroids."""
        unit = self.unit(x)
        return distances(unit[:, : self.half], self.first), distances(unit[:, self.half :], self.second)

    def reach(self, x: np.ndarray, rows: dict[int, int], wanted: int) -> list[float]:
        return [walk(p, q, rows, wanted) for p, q in zip(*self.sums(x), strict=True)]


def by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(components, places, vectors as a matrix) for each number of components among ``vectors``."""
    length = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, dtype=np.int64)
    for dims in np.unique(length).tolist():
        at = np.flatnonzero(length == dims)
        yield dims, at, matrix(pa.chunked_array([vectors.take(pa.array(at))]), float)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of q and each row, each summed in the same order whatever stands beside it."""
    x, q = x / np.abs(x).max(axis=1, keepdims=True), q / np.abs(q).max()
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def near_vectors(
    vectors: DataFrame,
    is_query: str = "vec_id % 50 = 0",
    k: int = K,
    candidates: float = CANDIDATES,
    sample_rows: int = SAMPLE_ROWS,
    block_rows: int = BLOCK_ROWS,
    bundle_rows: int = BUNDLE_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k found rows of largest cosine for each query.

    ``vectors`` has vec_id and embedding. Queries are the rows for which
    ``is_query`` holds; candidates are all rows with another id and as many
    components, of which a share of ``candidates`` (1000 rows at least) is
    ranked. Rows without an id, NULL, empty and zero vectors and those with a
    NULL or non-finite component take no part. Rows equal in both columns are
    one row. Ties go to the smaller id. Other columns are ignored. No row gives
    no row.
    """
    spark = vectors.sparkSession
    rows = valid(vectors).where(F.exists("embedding", lambda x: x != 0)).withColumn("dims", F.size("embedding"))
    # One short row for each number of components.
    sizes = {r.dims: r["count"] for r in rows.groupBy("dims").count().collect()}
    rows = rows.dropDuplicates(["vec_id", "embedding"])
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    kept = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")

    sample = of_least_hash(rows, sum(sizes.values()), sample_rows, "vec_id").select("embedding").toArrow()["embedding"]
    fitted = {}
    for dims, _, x in by_length(sample.combine_chunks()):
        if dims > 1:
            fitted[dims] = MultiIndex(x, int(min(MOST_CENTROIDS, max(4, sizes[dims] // ROWS_PER_CENTROID))))
    index = spark.sparkContext.broadcast(fitted)

    @F.arrow_udf("long")
    def cell_of(found: pa.Array) -> pa.Array:
        cells = np.zeros(len(found), dtype=np.int64)
        for dims, at, x in by_length(found):
            if dims in index.value:
                cells[at] = index.value[dims].cell(x)
        return pa.array(cells)

    indexed = durable(kept.withColumn("cell", cell_of("embedding")))
    # At most MOST_CENTROIDS^2 cells of each number of components, and no more than rows.
    cells = indexed.groupBy("dims", "cell").count().collect()
    held: dict[int, dict[int, int]] = {}
    for r in cells:
        held.setdefault(r.dims, {})[r.cell] = r["count"]
    total = {dims: sum(n.values()) for dims, n in held.items()}
    wanted = {dims: max(1000, int(candidates * n)) + k + 1 for dims, n in total.items()}
    known = spark.sparkContext.broadcast((held, wanted))

    @F.arrow_udf("double")
    def reach_of(asked: pa.Array) -> pa.Array:
        held, wanted = known.value
        reach = np.full(len(asked), np.inf)
        for dims, at, x in by_length(asked):
            if dims in index.value:
                reach[at] = index.value[dims].reach(x, held[dims], wanted[dims])
        return pa.array(reach)

    # Large cells are cut into blocks, and blocks are dealt into bundles.
    cut = [(r.dims, r.cell, r["count"], -(-total[r.dims] // bundle_rows)) for r in cells]
    table = spark.createDataFrame(cut or [(0, -1, 1, 1)], "dims int, cell long, n long, bundles long")
    table = table.withColumn("blocks", F.ceil(F.col("n") / block_rows))
    right = indexed.join(table, ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    right = right.withColumn("bundle", F.pmod(F.xxhash64("cell", "block"), F.col("bundles")))
    asked = rows.where(is_query)
    parts = -(-asked.count() // query_rows) or 1
    right = right.withColumn("part", numbers(F.lit(parts)))
    keys = ["dims", "part", "bundle"]
    # Tasks by number, as walks and groups cost far more than their bytes tell.
    tasks = 4 * partitions(spark)
    right = right.select(*keys, "cell", "vec_id", "embedding").toDF(*keys, "cell", "vec_id", "embedding")
    spread = asked.repartition(tasks, "vec_id")
    left = durable(spread.withColumn("reach", reach_of("embedding")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))))
    left = left.join(table.select("dims", "bundles").distinct(), "dims").withColumn("bundle", numbers(F.col("bundles")))

    def meet(query: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if query.num_rows and found.num_rows:
            cell = found["cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            cells, sizes = np.unique(cell, return_counts=True)
            ids, x = found["vec_id"].to_numpy()[order], matrix(found["embedding"], float)[order]
            unit, q = MultiIndex.unit(x), matrix(query["embedding"], float)
            near = np.ones((len(q), len(cells)), dtype=bool)
            if x.shape[1] in index.value:
                a, b = index.value[x.shape[1]].sums(q)
                near = a[:, cells // b.shape[1]] + b[:, cells % b.shape[1]] <= query["reach"].to_numpy()[:, None] + 1e-9
            for qid, v, u, walked in zip(query["vec_id"].to_pylist(), q, MultiIndex.unit(q), near, strict=True):
                at = np.flatnonzero(np.repeat(walked, sizes))
                at = at[ids[at] != qid]
                if not len(at):
                    continue
                rough = unit[at] @ u
                if len(at) > k:
                    at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - 1e-9]
                score = cosines(x[at], v)
                for i in np.lexsort((ids[at], -score))[:k]:
                    out.append((qid, int(ids[at[i]]), float(score[i])))
        columns = list(zip(*out, strict=True)) or [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    result = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    return best(result, k)
