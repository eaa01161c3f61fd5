"""Near duplicates by Order MinHash, verified by banded alignment.

A text is a sequence of shingles of five words. The similarity of two texts is
the lesser of two: that of the best alignment of their sequences (shared
shingles, in order, divided by all shingles of both), and the Jaccard similarity
of their distinct shingles. The first never exceeds the Jaccard similarity of
the occurrence-labelled shingles and falls when passages change places; the
second keeps apart texts that share little but one passage repeated often.

Order MinHash: under each of ``sketches`` hash functions ``sample``
occurrence-labelled shingles are taken by their hashes and hashed in their text
order. Texts with an equal sketch share a bucket. In a bucket the member that
shares most buckets with others is aligned with all members. A member that is
then outside the leader's component, a stray, may still be similar to others:
it is aligned with those members of the leader's buckets in other components
that share one of its rarest shingles. Two sets of n and m items with a Jaccard
similarity of t share at least a = t / (1 + t) * (n + m), so, each in the same
order, they share one of the first n - a + 1 and m - a + 1. The order is by how
few members have a shingle, so that what a whole group shares proposes nothing,
and no link between members of a bucket that would join two components is
missed. A group of n near copies thus costs about n alignments.

Sketches of few shingles agree too rarely: those of 4 and 5 never do. So texts of
at most ``SHORT`` shingles, and those long enough to be similar to one, share a
bucket also for each of their first rarest shingles, counted over all such
texts: by the same bound on the shared shingles no similar pair is without one.

At a similarity of 0.8, two long texts of equal order share a bucket with a
probability near 1 - (1 - 0.8^5)^24 > 0.9999; the README has measured rates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import U, WordHashes, batches, durable, mixed, shingles, small_batches, text_of
from shelfsight.llm.components import components

SKETCHES = 24
SAMPLE = 5
SHINGLE = 5
SIMILARITY = 0.8
SHORT = 40


def words_of(text: str) -> list[str]:
    return text.lower().split()


def labelled(items: np.ndarray) -> np.ndarray:
    """Items made distinct: the n-th copy of one gets the label n."""
    order = np.argsort(items, kind="stable")
    ranked = items[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    at = np.arange(len(items))
    label = np.empty(len(items), dtype=U)
    label[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(U)
    return np.where(label == 0, items, mixed(items ^ mixed(label, 7), 11))


def order_minhash(items: np.ndarray, sketches: int, sample: int) -> np.ndarray:
    """One 64-bit sketch for each hash function.

    The sample is the ``sample`` - 1 least hashes of all labelled shingles and
    the greatest of the distinct ones, so that a passage repeated hundreds of
    times doesn't make up a sample by itself.
    """
    named = labelled(items)
    once = np.flatnonzero(named == items)
    least = min(max(sample - 1, 1), len(named))
    out = []
    # A long text takes its hash functions a few at a time, to bound the table of hashes.
    step = max(1, 1_000_000 // len(named))
    for low in range(0, sketches, step):
        own = np.arange(low + 1, min(low + step, sketches) + 1, dtype=U)
        table = mixed(named[None, :] + mixed(own)[:, None])
        at = np.argpartition(table, least - 1, axis=1)[:, :least]
        at = np.column_stack([at, once[table[:, once].argmax(axis=1)]])
        at.sort(axis=1)
        value = own
        for j in range(at.shape[1]):
            value = mixed(value ^ named[at[:, j]], 99)
        out.append(value)
    return np.concatenate(out)


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence of a and b, or less than ``least``.

    Only the diagonals that an alignment of ``least`` matches can reach count:
    it skips at most len(a) - least items of a and len(b) - least of b. The
    rows of the table are the bits of one integer.
    """
    n, m = len(a), len(b)
    if least > min(n, m):
        return 0
    same = a[: min(n, m)] == b[: min(n, m)]
    head = len(same) if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    k = min(len(a), len(b))
    same = a[len(a) - k :][::-1] == b[len(b) - k :][::-1]
    tail = k if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    shared = head + tail
    if not len(a) or not len(b) or shared + min(len(a), len(b)) < least:
        return shared
    if shared + len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < least:
        return shared
    skip_a, skip_b = n - least, m - least
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    band = (1 << (skip_a + skip_b + 1)) - 1
    row = full
    for j, x in enumerate(b.tolist()):
        hits = where.get(x, 0)
        if hits:
            shift = j - skip_b
            hits &= band << shift if shift >= 0 else band >> -shift
            hits &= row
            if hits:
                row = ((row + hits) | (row - hits)) & full
    return shared + len(a) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether distinct shared / distinct of both and aligned / all of both reach the similarity."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < similarity * max(n, m):
        return False
    one, other = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(one, other, assume_unique=True))
    if shared < similarity * (len(one) + len(other) - shared) - 1e-9:
        return False
    least = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
    return aligned(a, b, least) >= least


def _sketched(df: DataFrame, sketches: int, sample: int, shingle: int, short: int) -> DataFrame:
    """(doc_id, copy, size, sketches, items); ``items`` are the distinct shingles of texts of at most ``short``."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches(frames):
            size, found, few = [], [], []
            for text in batch.column("text").to_pylist():
                items = shingles(hashes.of(words_of(text)), shingle)
                size.append(len(items))
                found.append(order_minhash(items, sketches, sample).view(np.int64).tolist() if len(items) else [])
                few.append(np.unique(items).view(np.int64).tolist() if len(items) <= short else [])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (found, few)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("copy"), pa.array(size, pa.int64()), *lists],
                ["doc_id", "copy", "size", "sketches", "items"],
            )

    return df.mapInArrow(run, "doc_id long, copy binary, size long, sketches array<long>, items array<long>")


def _items(df: DataFrame, shingle: int) -> DataFrame:
    """(copy, items): the hashed shingles of each text in order, 8 bytes each."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches(frames):
            texts = batch.column("text").to_pylist()
            items = [shingles(hashes.of(words_of(t)), shingle).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("copy"), pa.array(items, pa.binary())], ["copy", "items"])

    return df.select("copy", "text").mapInArrow(run, "copy binary, items binary")


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v, left, right) whose items are similar."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            sides = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())
            keep = [similar(np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U), similarity) for x, y in sides]
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(keep)) for c in (batch.column("u"), batch.column("v"))], ["u", "v"]
            )

    return pairs.select("u", "v", "left", "right").mapInArrow(run, "u binary, v binary")


def _rarest(family: DataFrame, wanted: DataFrame, similarity: float) -> DataFrame:
    """``family`` (main, copy, root, stray) by the first shingles of each member, the rarest of its ``main`` first.

    ``n`` counts a member's distinct shingles and ``pos`` the ones before. There
    are as many as any text of a similarity can need; those of one member are left out.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            items = [np.unique(np.frombuffer(x, dtype=U)).view(np.int64) for x in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("main", "copy", "root", "stray")] + [pa.array(items, pa.list_(pa.int64()))],
                ["main", "copy", "root", "stray", "items"],
            )

    kept = "main binary, copy binary, root binary, stray boolean"
    read = family.join(wanted, "copy").select("main", "copy", "root", "stray", "items").mapInArrow(run, f"{kept}, items array<long>")
    each = durable(read.select("main", "copy", "root", "stray", F.size("items").alias("n"), F.explode("items").alias("item")))
    common = each.groupBy("main", "item").agg(F.count("*").alias("members"))
    ranked = each.join(common, ["main", "item"]).groupBy("main", "copy", "root", "stray", "n").agg(
        F.array_sort(F.collect_list(F.struct("members", "item"))).alias("items")
    )
    first = F.slice("items", F.lit(1), (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int"))
    out = ranked.select("main", "copy", "root", "stray", "n", F.posexplode(first).alias("pos", "of"))
    return durable(out.where("of.members > 1").select("main", "copy", "root", "stray", "n", "pos", F.col("of.item").alias("item")))


def _short_buckets(classes: DataFrame, similarity: float) -> DataFrame:
    """(copy, size, bucket): the first shingles of each short text, the rarest of all short texts first."""
    each = classes.select("copy", "size", F.size("items").alias("n"), F.explode("items").alias("item"))
    common = each.groupBy("item").agg(F.count("*").alias("members"))
    ranked = each.join(common, "item").groupBy("copy", "size", "n").agg(
        F.array_sort(F.collect_list(F.struct("members", "item"))).alias("items")
    )
    first = F.slice("items", F.lit(1), (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int"))
    out = ranked.select("copy", "size", F.explode(first).alias("of")).where("of.members > 1")
    return out.select("copy", "size", F.xxhash64(F.lit("short"), "of.item").alias("bucket"))


def near_duplicate_classes(
    documents: DataFrame,
    sketches: int = SKETCHES,
    sample: int = SAMPLE,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(doc_id, copy, class_id, stays) for each row of ``documents`` (doc_id, text).

    ``copy`` is the MD5 of the text, ``class_id`` the least doc_id of the class
    (NULL if all are NULL) and ``stays`` is true for one row of each class.
    Texts are compared by whole words in lower case. A NULL text is an empty
    one; texts without words are alike only if equal. Rows that share a doc_id
    are rows of their own; rows equal in both are interchangeable. Other
    columns are ignored. No row gives no row.
    Rows equal in doc_id and text carry the same flag; ``one_of_each`` keeps one.
    """
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select("doc_id", text_of("text").alias("text"))
    texts = texts.select("doc_id", "text", F.unhex(F.md5("text")).alias("copy"))
    rows = durable(_sketched(texts, sketches, sample, shingle, math.floor(SHORT / similarity)))

    classes = durable(
        rows.groupBy("copy").agg(
            F.min("doc_id").alias("first_id"),
            F.first("size").alias("size"),
            F.first("sketches").alias("sketches"),
            F.first("items").alias("items"),
        )
    )
    members = classes.select("copy", "size", F.explode(F.array_distinct("sketches")).alias("bucket"))
    members = members.unionByName(_short_buckets(classes, similarity))
    counts = members.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    # How many others a member meets, over all its buckets: the centre of a star comes first.
    shared = durable(members.join(counts, "bucket"))
    degree = shared.groupBy("copy").agg(F.sum("members").alias("degree"))
    ranked = shared.join(degree, "copy").select("bucket", F.struct((-F.col("degree")).alias("d"), "copy", "size").alias("rank"))
    leaders = ranked.groupBy("bucket").agg(F.min("rank").alias("first"))
    leaders = durable(leaders.select("bucket", F.col("first.copy").alias("main"), F.col("first.size").alias("main_size")))

    # Joined on both keys, so that the rows of a large group of copies are dealt out.
    chosen = classes.join(shared.select("copy").distinct(), "copy").select(
        "copy", F.coalesce("first_id", F.lit(-1)).alias("id")
    )
    wanted = texts.withColumn("id", F.coalesce("doc_id", F.lit(-1))).join(chosen, ["copy", "id"], "left_semi")
    wanted = durable(_items(wanted.groupBy("copy").agg(F.first("text").alias("text")), shingle))

    def checked(pairs: DataFrame) -> DataFrame:
        left = wanted.select(F.col("copy").alias("u"), F.col("items").alias("left"))
        right = wanted.select(F.col("copy").alias("v"), F.col("items").alias("right"))
        return durable(_verified(pairs.join(left, "u").join(right, "v"), similarity))

    u, v = F.least("copy", "other").alias("u"), F.greatest("copy", "other").alias("v")
    alike = F.least("size", "main_size") >= similarity * F.greatest("size", "main_size")
    placed = shared.join(leaders, "bucket").select("copy", "main", "size", "main_size").distinct()
    placed = durable(placed.where("copy != main"))
    done = durable(placed.where(alike).withColumnRenamed("main", "other").select(u, v).distinct())
    links = checked(done)
    roots = components(links)

    def rooted(df: DataFrame, column: str, to: str) -> DataFrame:
        named = roots.select(F.col("node").alias(column), F.col("root").alias(to))
        return df.join(named, column, "left").withColumn(to, F.coalesce(to, column))

    family = rooted(rooted(placed.select("copy", "main"), "copy", "root"), "main", "main_root")
    # The stars of one component share their members, so they make one family.
    family = family.select(F.col("main_root").alias("main"), "copy", "root").distinct()
    family = durable(family.withColumn("stray", F.col("root") != F.col("main")))
    troubled = family.where("stray").groupBy("main").agg(F.count("*").alias("strays"))
    rare = _rarest(family.join(troubled, "main", "left_semi"), wanted, similarity)
    strays = rare.where("stray").select(
        "main", "item", F.col("copy").alias("other"), F.col("root").alias("other_root"),
        F.col("n").alias("other_n"), F.col("pos").alias("other_pos"),
    )
    least = F.ceil((F.col("n") + F.col("other_n")) * (similarity / (1 + similarity)) - 1e-6)
    meets = (F.col("pos") + least <= F.col("n")) & (F.col("other_pos") + least <= F.col("other_n"))
    apart = F.col("root") != F.col("other_root")
    pairs = rare.join(strays, ["main", "item"]).where(apart & meets).select(u, v).distinct()
    more = checked(durable(pairs.join(done, ["u", "v"], "left_anti")))
    known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = components(known.union(more))
    named = classes.select("copy", "first_id").join(roots, classes.copy == roots.node, "left")
    named = named.select("copy", "first_id", F.coalesce("root", "copy").alias("root"))
    whole = named.groupBy("root").agg(
        F.min("first_id").alias("class_id"),
        F.min(F.struct(F.col("first_id").isNull(), "first_id", "copy")).alias("keep"),
    )
    named = named.join(whole, "root").select(
        "copy", "class_id", (F.col("keep.copy") == F.col("copy")).alias("kept"), "first_id"
    )
    out = rows.select("doc_id", "copy").join(named, "copy")
    return out.select("doc_id", "copy", "class_id", (F.col("kept") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("stays"))


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with one row of each class of near duplicates, in all its columns."""
    classes = near_duplicate_classes(documents, **options)
    keep = classes.where("stays").select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).distinct()
    named = documents.withColumn("_copy", F.unhex(F.md5(text_of("text"))))
    kept = named.join(keep, named["doc_id"].eqNullSafe(keep["_id"]) & (named["_copy"] == keep["_copy"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_copy"]).drop("_copy")
