"""Hard negatives by Kronecker-packed products.

The components of several candidates are biased so that none is negative and
put into separated fields of one wide integer, a word, for each component. A
field is as wide as the largest product needs, so one multiplication by an
anchor's component serves all candidates of the word, and sums never run from
one field into the next. Unpacked, and freed from the bias, the scores are exact.
Words of 53 bits are held in doubles, which are exact up to there and multiply
fastest; where not even two fields fit, Python's integers hold ``WIDE`` fields.

Anchors meet candidates in blocks, twice: first those of their own label, which
yield the positives, then all others, of which only scores inside some positive's
bounds are looked at. Blocks are dealt by hash of the id, so a label of any size
and any number of equal vectors are split. A task passes on only the best of its
block: at most ``positives`` or ``positives * negatives`` rows an anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.llm.common import partitions, stored
from shelfsight.llm.vectors import matrix, valid

POSITIVES = 5
NEGATIVES = 3
LEAST, MOST = 50, 95  # Percent of a positive's score.
BLOCK_ROWS = 16_384
ANCHOR_ROWS = 16_384
SMALL_BLOCK = 512  # Below a block for each partition, blocks may be as small as this.
TILE = 256
WORD_BITS = 53
WIDE = 16


class Packed:
    """Rows of integers, packed for products with anchors whose components lie between ``low`` and ``high``."""

    def __init__(self, rows: np.ndarray, low: int, high: int):
        self.count, self.dims = rows.shape
        self.low, self.bias = low, int(rows.min())
        largest = int(rows.max())
        most = self.dims * (high - low) * (largest - self.bias)
        self.width = max(1, most.bit_length())
        reach = self.dims * max(abs(low), abs(high)) * max(abs(self.bias), abs(largest))
        self.exact = WORD_BITS // self.width >= 2 and reach < 2**61
        self.fields = WORD_BITS // self.width if self.exact else WIDE
        kind = np.int64 if self.exact else object
        rows = rows.astype(kind)
        self.sums = rows.sum(axis=1)
        # Candidate f * words + w lies in field f of word w.
        self.words = -(-self.count // self.fields)
        biased = np.zeros((self.fields * self.words, self.dims), dtype=kind)
        biased[: self.count] = rows - self.bias
        packed = biased[: self.words].copy()
        for f in range(1, self.fields):
            packed += biased[f * self.words : (f + 1) * self.words] * (1 << (self.width * f))
        self.packed = packed.astype(float).T.copy() if self.exact else packed.T

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Inner product of each anchor (a row) and each packed row; beyond 64 bits held at the limit."""
        kind = np.int64 if self.exact else object
        anchors = anchors.astype(kind)
        word = ((anchors - self.low).astype(self.packed.dtype) @ self.packed).astype(kind)
        mask = (1 << self.width) - 1
        fields = [(word >> (self.width * f)) & mask for f in range(self.fields)]
        # The product of the biased rows is a*c - bias*sum(a) - low*sum(c) + dims*low*bias.
        free = self.bias * anchors.sum(axis=1)[:, None] - self.dims * self.low * self.bias
        out = np.concatenate(fields, axis=1)[:, : self.count] + free + self.low * self.sums
        return out if self.exact else np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)


def tiles(anchors: np.ndarray, rows: np.ndarray):
    """(place, scores) of each anchor with all rows, one exact product after the other."""
    packed = Packed(rows, int(anchors.min()), int(anchors.max()))
    for at in range(0, len(anchors), TILE):
        scores = packed.products(anchors[at : at + TILE])
        for i, row in enumerate(scores):
            yield at + i, row


def by_id(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Ids, labels and vectors in the order of the ids, so that of equal scores the first wins."""
    ids = table["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], table["label"].to_numpy()[order], matrix(table["v"], np.int64)[order]


def nearest_alike(asked: pa.Table, rows: pa.Table, k: int) -> list[tuple]:
    """(anchor, positive_id, positive_score): the k best of ``rows`` for each anchor but itself."""
    ids, _, v = by_id(rows)
    out = []
    names = asked["anchor"].to_pylist()
    own = asked["vec_id"].to_numpy()
    for i, score in tiles(matrix(asked["v"], np.int64), v):
        at = np.flatnonzero(ids != own[i])
        if len(at) > k:
            near = score[at]
            at = at[near >= np.partition(near, len(near) - k)[len(near) - k]]
        for j in at[np.argsort(~score[at], kind="stable")][:k]:
            out.append((names[i], int(ids[j]), int(score[j])))
    return out


def hardest_unlike(asked: pa.Table, rows: pa.Table, k: int, least: int, most: int) -> list[tuple]:
    """(anchor, place of the positive, negative_id, negative_score): the k best within each positive's bounds."""
    ids, labels, v = by_id(rows)
    out = []
    names, goals = asked["anchor"].to_pylist(), asked["goals"].to_pylist()
    own, label = asked["vec_id"].to_numpy(), asked["label"].to_numpy()
    for i, score in tiles(matrix(asked["v"], np.int64), v):
        bounds = [(max(-((-least * g) // 100), -(2**63)), min(most * g // 100, 2**63 - 1)) for g in goals[i]]
        low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)
        at = np.flatnonzero((score >= low) & (score <= high) & (labels != label[i]) & (ids != own[i]))
        at = at[np.argsort(~score[at], kind="stable")]
        falling = ~score[at]
        for place, (lowest, highest) in enumerate(bounds):
            begin = int(np.searchsorted(falling, ~highest, side="left")) if lowest <= highest else len(at)
            out += [(names[i], place, int(ids[j]), int(score[j])) for j in at[begin : begin + k] if score[j] >= lowest]
    return out


def met(asked: DataFrame, rows: DataFrame, keys: list[str], schema: str, work) -> DataFrame:
    """``work`` on each group of anchors and rows that share ``keys``, where both have some."""
    # Groups are few and cost far more than their bytes tell: a number given by hand keeps them apart.
    parts = 4 * partitions(asked.sparkSession)
    kinds = [pa.int64()] * len(schema.split(","))
    names = [c.split()[0] for c in schema.split(",")]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = work(a, b) if a.num_rows and b.num_rows else []
        columns = list(zip(*found, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    left, right = (df.repartition(parts, *keys) for df in (asked, rows))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def pieces(count: Column, rows: int) -> Column:
    return F.greatest(F.ceil(count / rows), F.lit(1)).cast("long")


def every(count: Column) -> Column:
    """0 .. count - 1 as rows."""
    return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: str = "vec_id % 50 = 0",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    scale: int = 256,
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, embedding and a whole number as label; a component x
    counts as floor(scale * x). Anchors are the rows for which ``is_anchor``
    holds, their positives the ``positives`` rows of the same label with the
    highest products, and the negatives of a positive the ``negatives`` highest
    rows of another label whose product is ``least`` to ``most`` percent of the
    positive's. Ties go to the smaller id; rank starts from 1.

    Rows without an id or a label, NULL or empty vectors and those with a NULL or
    non-finite component take no part, and only vectors with the same number of
    components meet. A row with the anchor's id is neither its positive nor its
    negative. A repeated row counts each time, as an anchor once. An anchor
    without positives, and a positive without negatives, give no row; nor does
    an empty table. A product beyond 64 bits is held at the limit. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    rows = valid(vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label")), "label").where("label is not null")
    ints = stored(
        rows.select(
            "vec_id", "label", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v"), F.size("embedding").alias("dims")
        )
    )
    anchors = stored(
        ints.where(is_anchor).dropDuplicates(["vec_id", "label", "v"]).withColumn("anchor", F.monotonically_increasing_id())
    )
    sizes = ints.groupBy("dims", "label").agg(F.count("*").alias("n"), F.count_if(F.expr(is_anchor)).alias("asked"))
    sizes = stored(sizes.where("asked > 0"))
    deal = F.xxhash64("vec_id")

    alike = sizes.select("dims", "label", pieces(F.col("n"), block_rows).alias("blocks"), pieces(F.col("asked"), anchor_rows).alias("parts"))
    near = met(
        anchors.join(alike, ["dims", "label"])
        .withColumn("part", F.pmod(deal, F.col("parts")))
        .withColumn("block", every(F.col("blocks")))
        .select("dims", "label", "block", "part", "anchor", "vec_id", "v"),
        ints.join(alike, ["dims", "label"])
        .withColumn("block", F.pmod(deal, F.col("blocks")))
        .withColumn("part", every(F.col("parts")))
        .select("dims", "label", "block", "part", "vec_id", "v"),
        ["dims", "label", "block", "part"],
        "anchor long, positive_id long, positive_score long",
        lambda a, b: nearest_alike(a, b, positives),
    )
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives)
    near = stored(near)
    goals = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("goals"))
    goals = goals.withColumn("goals", F.col("goals.positive_score"))

    # Labels don't matter for blocks now; small tables are cut as well, so that all cores have some.
    total = ints.groupBy("dims").agg(F.count("*").alias("n"))
    asked = anchors.groupBy("dims").agg(F.count("*").alias("asked"))
    small = F.least(F.lit(partitions(spark)), pieces(F.col("n"), SMALL_BLOCK))
    unlike = total.join(asked, "dims").select(
        "dims", F.greatest(pieces(F.col("n"), block_rows), small).alias("blocks"), pieces(F.col("asked"), anchor_rows).alias("parts")
    )
    unlike = stored(unlike)
    hard = met(
        anchors.join(goals, "anchor")
        .join(unlike, "dims")
        .withColumn("part", F.pmod(deal, F.col("parts")))
        .withColumn("block", every(F.col("blocks")))
        .select("dims", "block", "part", "anchor", "vec_id", "label", "v", "goals"),
        ints.join(unlike, "dims")
        .withColumn("block", F.pmod(deal, F.col("blocks")))
        .withColumn("part", every(F.col("parts")))
        .select("dims", "block", "part", "vec_id", "label", "v"),
        ["dims", "block", "part"],
        "anchor long, place long, negative_id long, negative_score long",
        lambda a, b: hardest_unlike(a, b, negatives, least, most),
    )
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return (
        hard.join(near, ["anchor", "place"])
        .join(names, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
