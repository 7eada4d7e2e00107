"""What the operators on vectors share: which vectors count, and classes of equal vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_GOOD = "embedding is not null and size(embedding) > 0 and forall(d, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(d, x -> x <> 0)"


def parted(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, embedding) of the vectors that take part, and of the others. Those take part that are not null or empty, have no
    null or non-finite components, and are not zero."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("d"), "embedding")
    good = F.coalesce(F.expr(_GOOD), F.lit(False))
    return rows.where(good).select("vec_id", "embedding"), rows.where(~good).select("vec_id", "embedding")


def by_length(good: DataFrame) -> list[DataFrame]:
    """The vectors of each length, which are joined and searched among themselves."""
    lengths = sorted(r[0] for r in good.select(F.size("embedding")).distinct().collect())
    return [good.where(F.size("embedding") == n) for n in lengths]


def classes(good: DataFrame) -> DataFrame:
    """(cid, n, embedding): equal vectors are one class, named by its smallest vec_id."""
    return good.groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n")).select("cid", "n", "embedding")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))
