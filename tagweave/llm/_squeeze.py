"""Small codecs for the integer arrays that cross a shuffle, and the number of fragments for a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CODEC = pa.Codec("zstd", 1)


def squeeze(x: np.ndarray, rising: bool = False) -> bytes:
    """32-bit values as bytes: differences if they rise, bytes of equal weight together, zstd."""
    x = np.ascontiguousarray(x, np.uint32)
    if rising and len(x):
        x = np.diff(x, prepend=np.uint32(0))
    planes = x.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(x).to_bytes(4, "little") + _CODEC.compress(planes, asbytes=True)


def expand(raw: bytes, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(_CODEC.decompress(raw[4:], decompressed_size=4 * n), np.uint8)
    x = np.ascontiguousarray(planes.reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(x, dtype=np.uint32) if rising else x


def fragment_count(docs: DataFrame, units: int = 1 << 20, bytes_a_unit: int = 6) -> int:
    """So many fragments that one holds about `units` words' worth of the whole table's text."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(1, -(-total // (units * bytes_a_unit)))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts values, where each run of equal ones starts in it, and each element's run."""
    order = np.argsort(values)
    fresh = np.ones(len(order), bool)
    fresh[1:] = values[order[1:]] != values[order[:-1]]
    return order, np.flatnonzero(fresh), np.cumsum(fresh) - 1


