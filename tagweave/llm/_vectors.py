"""Vectors of Arrow list columns as matrices, and the choice of those that take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usual_length(vectors: DataFrame) -> int:
    """The commonest number of components (the smaller one on a tie); 0 for no vector."""
    row = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors of d finite components and a norm above 0, and those vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == d) if d else np.zeros(0, np.int64)
    flat = column.take(pa.array(rows)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), d)
    good = np.isfinite(x).all(1) & (np.abs(x).max(1, initial=0) > 0)
    return rows[good], x[good]


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, scaled so that squares neither overflow nor vanish."""
    top = np.abs(x).max(1, initial=0)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def sample(vectors: DataFrame, d: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components of at most n of the vectors that take part, chosen by hash of the id: bounded, brought to the driver."""
    rows = vectors.where("vec_id is not null and embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id", "embedding").limit(n).toArrow()
    which, x = matrix(rows.column("embedding"), d)
    return rows.column("vec_id").to_numpy()[which], x


def one_each(vectors: DataFrame, d: int) -> DataFrame:
    """(vec_id, embedding): for every id the least, component by component, of its vectors of d finite components and a norm above 0."""
    size = lambda x: F.abs(x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (size(x) < float("inf")))
    good = (F.size("embedding") == d) & finite & F.exists("embedding", lambda x: size(x) > 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
