"""Words and hashes of many texts at once, in numpy, straight from Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MUL = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(int(_MUL), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the public splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * _MUL)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for key, base in (("up", _MUL), ("down", _INV)):
            p = np.full(max(n, 1 << 20), base, U64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and len + 1 offsets into them. Null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(raw) else raw, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batches, each of at most limit bytes of text or of one row: memory follows the limit, not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09-0x0D, and len + 1 offsets of each text's words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    word = ~_SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * _MUL)


def window_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes; ranges that cross texts are there too, for the caller to leave out."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= _MUL
        out += word[j : j + n]
    return mix(out)


def within(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows of k words that lie in one text, and each window's text. offsets: of each text's words."""
    count = np.maximum(np.diff(offsets) - k + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][owner]
    return first, owner
