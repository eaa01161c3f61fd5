"""Helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfsight.session import ensure_checkpoint_dir

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(column), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Bound what a Python worker gets at once, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in that folder: its true size is known when a join is planned."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def of_least_hash(df: DataFrame, count: int, keep: int, *keys: str) -> DataFrame:
    """The ``keep`` rows of least hash of ``keys``, of a table of ``count`` rows.

    Only rows below an edge, about twice as many as are kept, are put in order,
    so what meets in one task doesn't grow with the table.
    """
    place = F.xxhash64(*keys)
    share = (2 * keep + 1000) / max(count, 1)
    some = df if share >= 1 else df.where(place < F.lit(int(2**64 * share) - 2**63))
    return some.orderBy(place, *keys).limit(keep)


def running(df: DataFrame, keys: list[str], group: str, order: list, value: str | list[str], to: str | list[str]) -> DataFrame:
    """df with the sum of each ``value`` over the rows before, per key; ``group`` cuts a key's order into short runs."""
    pairs = [(value, to)] if isinstance(value, str) else list(zip(value, to, strict=True))
    totals = df.groupBy(*keys, group).agg(*[F.sum(v).alias(f"_total_{t}") for v, t in pairs])
    over = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, group, *[F.coalesce(F.sum(f"_total_{t}").over(over), F.lit(0)).alias(f"_start_{t}") for _, t in pairs])
    inside = Window.partitionBy(*keys, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(starts, [*keys, group])
    sums = {t: F.col(f"_start_{t}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v, t in pairs}
    return joined.withColumns(sums).drop(*[f"_start_{t}" for _, t in pairs])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads them evenly; one for each seed."""
    with np.errstate(over="ignore"):
        x = (x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)).astype(U)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class WordHashes(dict):
    """64-bit hash of a word, the same on every machine; forgets when it holds too many."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.array([self[w] for w in words], dtype=U)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; a shorter text is one shingle."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    last = len(words) - size + 1
    out = np.zeros(last, dtype=U)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = mixed(out * U(0x100000001B3) + words[j : j + last])
    return out


def release() -> None:
    """Give back what a worker process holds of the task before: it lives on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batches(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    release()
    return (b for b in frames if b.num_rows)
