"""Tables of vectors as blocks: many vectors in one row, for numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def usable(column: pa.Array, dim: int | None, zero: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors in double precision).

    A vector takes part unless it is null, empty, of another length than ``dim`` (the first vector's where None), holds null
    or non-finite components, or, without ``zero``, is zero.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(0), np.int64)
    good = size == (dim or (size[size > 0][0] if (size > 0).any() else 0))
    good &= size > 0
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), np.float64)
    start = np.cumsum(size) - size
    rows = np.flatnonzero(good)
    if not len(rows):
        return rows, np.zeros((0, dim or 0))
    x = values[start[rows][:, None] + np.arange(size[rows[0]])]
    fine = np.isfinite(x).all(1)
    if not zero:
        fine &= (x != 0).any(1)
    return rows[fine], x[fine]


def dimension(vectors: DataFrame, column: str) -> int:
    """The commonest length of the vectors (the least of equally common ones); 0 without any."""
    from pyspark.sql import functions as F

    row = vectors.groupBy(F.size(column).alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    return row.n if row else 0


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, largest first, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]
