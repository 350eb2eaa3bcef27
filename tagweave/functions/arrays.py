"""Arrow columns as numpy arrays, for functions over batches of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """A column of vectors as rows of doubles; null ones, those of another width or with null components are rows of zeros."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    width = int(size.max(initial=0)) if width is None else width
    out = np.zeros((len(column), width))
    fit = size == width
    if width and fit.any():
        flat = column.filter(pa.array(fit)).flatten()
        rows = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        if flat.null_count:
            rows = np.where(flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(1)[:, None], 0.0, rows)
        out[fit] = rows
    return out


def numbered(lists: pa.ListArray, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places in names) of the distinct known items of each list, by row, then place."""
    place = pc.index_in(lists.flatten(), names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    both = np.unique(row[place >= 0] * max(1, len(names)) + place[place >= 0])
    return both // max(1, len(names)), both % max(1, len(names))


def angular_of(dot: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - acos(cosine) / pi from inner products and norms; the cosine is 0 where a norm is 0."""
    norm = a * b
    cos = np.divide(dot, norm, out=np.zeros(np.broadcast_shapes(dot.shape, norm.shape)), where=norm != 0)
    return 1 - np.arccos(np.clip(cos, -1.0, 1.0)) / 3.141592653589793
