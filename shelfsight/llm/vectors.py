"""What the vector searches share: valid rows, blocks of queries, columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(vectors: DataFrame, *more: str) -> DataFrame:
    """(vec_id, embedding as doubles, ``more``) of rows with an id and only finite components, one at least."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *more
    )
    return rows.where("vec_id is not null and size(embedding) > 0").where(F.forall("embedding", finite))


def matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """A column of arrays of one length as the rows of a matrix."""
    if not len(column):
        return np.zeros((0, 0), dtype=dtype)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, the highest score first, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def numbers(count: Column) -> Column:
    """0 .. count - 1 as rows."""
    return F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))
