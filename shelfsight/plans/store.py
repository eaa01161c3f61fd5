"""Results kept between runs and found again by what they were made from."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "key string, folder string, written timestamp, name string"


class ResultStore:
    """Results as Parquet tables under ``path``, a folder that all executors reach.

    A result is known by its name, its parameters and a fingerprint of its input
    files. Written whole, it is entered in an index table; a run that ends
    before that leaves a folder that nothing refers to. Two runs that make the same
    result at once both write it, and either is read.

    Nothing is ever deleted. Whoever owns the folder may delete whole results
    at any time: one whose files are gone is made again.
    """

    def __init__(self, spark: SparkSession, path: str, version: str = "1"):
        """``version`` stands for the code: change it, and all results are made anew."""
        self.spark, self.path, self.version = spark, path.rstrip("/"), version
        none = spark.createDataFrame([], INDEX)
        none.write.mode("ignore").partitionBy("name").parquet(self._index)

    @property
    def _index(self) -> str:
        return f"{self.path}/index"

    def fingerprint(self, paths: str | Sequence[str]) -> str:
        """What the files under ``paths`` are: their number, paths, sizes and times, in any order.

        Files are listed, not opened, and no list of them reaches the driver: two
        sums of hashes and a count do.
        """
        paths = [paths] if isinstance(paths, str) else list(paths)
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
        marks = [F.xxhash64(F.lit(seed), "path", "length", "modificationTime") for seed in (1, 2)]
        sums = [F.sum(m.cast("decimal(20,0)")).cast("string").alias(f"s{i}") for i, m in enumerate(marks)]
        row = listed.agg(F.count(F.lit(1)).alias("files"), F.bit_xor(marks[0]).alias("x"), *sums).first()
        return "/".join(map(str, row))

    def key(self, name: str, paths: str | Sequence[str], params: dict[str, Any]) -> str:
        said = json.dumps([self.version, name, params], sort_keys=True, default=repr)
        return hashlib.sha256(f"{said}\n{self.fingerprint(paths)}".encode()).hexdigest()

    def _read(self, folder: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(folder)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def find(self, name: str, key: str) -> DataFrame | None:
        """The result entered under the key, the newest whose files are still there."""
        index = self.spark.read.schema(INDEX).parquet(self._index)
        known = index.where((F.col("name") == name) & (F.col("key") == key))
        for row in known.orderBy(F.desc("written"), "folder").select("folder").collect():
            result = self._read(row.folder)
            if result is not None:
                return result
        return None

    def keep(self, name: str, key: str, result: DataFrame) -> DataFrame:
        """Write a result, enter it, and read it back."""
        folder = f"{self.path}/results/{name}/{uuid.uuid4().hex}"
        result.write.parquet(folder)
        entry = self.spark.range(1).select(
            F.lit(key).alias("key"), F.lit(folder).alias("folder"), F.current_timestamp().alias("written"), F.lit(name).alias("name")
        )
        entry.write.mode("append").partitionBy("name").parquet(self._index)
        return self.spark.read.parquet(folder)

    def result(
        self, name: str, build: Callable[[], DataFrame], paths: str | Sequence[str], **params: Any
    ) -> DataFrame:
        """The stored result of ``build`` over the files under ``paths``, made only if it is not there.

        ``params`` are the values that ``build`` depends on besides the files.
        The rows come back in no particular order.
        """
        key = self.key(name, paths, params)
        found = self.find(name, key)
        return self.keep(name, key, build()) if found is None else found
