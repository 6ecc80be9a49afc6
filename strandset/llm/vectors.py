"""What the embedding operators share: which vectors take part, and reading them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(v: Column) -> Column:
    """Whether a vector may take part: not null or empty, no null, NaN or infinite component, not zero. Never null."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def usual_size(rows: DataFrame, vector_col: str = "v") -> int:
    """The most frequent number of components, the smaller one of equally frequent ones; 0 without rows. Vectors of other sizes take no part."""
    sizes = rows.groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return sizes[0]["n"] if sizes else 0


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows with an id and a sound vector, of any size."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & sound(F.col("v")))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An array<double> column as rows of a matrix."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def sample_matrix(rows: DataFrame, size: int, total: int, salt: str) -> np.ndarray:
    """About size of the total vectors, chosen by a hash of id and vector and sorted by both, for the driver to fit on; never more than twice as many."""
    chance = F.xxhash64("id", "v", F.lit(salt)).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    found = rows.where(chance < min(1.0, size / max(total, 1))).select("id", "v").limit(2 * size).orderBy("id", "v").toArrow()
    if not found.num_rows:  # all rows alike, say
        found = rows.select("id", "v").limit(1).toArrow()
    return matrix(found["v"])
