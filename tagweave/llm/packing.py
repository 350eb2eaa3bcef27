"""Packing token streams into sequences by order-preserving dynamic programming.

Each task reads its documents in order as one stream of ids, an end id after each. Cuts may fall at a document's end
(free), at a sentence's end, or, where no boundary is near, at a set stride; a cut's penalty is counted in tokens of
padding. The cheapest cuts of a stream follow from cost(j) = penalty(j) + min over i of cost(i) + padding(j - i): for
windows padded to their full length the minimum of cost(i) + i over the last `window` tokens is kept in a monotone
queue; windows of exactly a power of two need no padding and are looked up. No ids are shuffled, and a task holds one
block of the stream (or one document, if that is longer).

Defined cases: a null or empty text is its end id alone; a null doc_id, repeated rows and other columns of docs change
nothing; an empty table gives no sequence. The string of a token that the vocabulary's file adds (an end-of-text mark)
is that token's id, as the tokenizer has it.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tagweave.llm._bytes import pieces, span_hashes, text_bytes

WINDOW = 2048
END_ID = 1
SENTENCE, HARD = 12.0, 48.0
STRIDE = 128
BLOCK = 1 << 19
PIECE = 1 << 20
MOST_CACHED = 3_000_000
_STOP = np.zeros(256, bool)
_STOP[[*b".!?"]] = True
#: Bytes that can be part of a white-space character (ASCII ones, and the lead bytes of all the others).
_MARK, _ASCII_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[*b".,;:!?"]] = True
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
MANY = 4096


class Cutter:
    """Token ids of texts, from a cache of the runs between single spaces or line ends.

    A byte-level tokenizer of this family never joins a lone space or line end to what precedes it, nor a mark to a
    letter before it, and its added tokens hold none of these, so a text's ids are those of its runs, each beginning
    with its space or mark. Places next to other white space are not used as bounds. The cache is looked up by hash and confirmed by bytes; it starts anew
    beyond MOST_CACHED runs.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        words = self.tokenizer.get_vocab(with_added_tokens=True)  # a byte-level token has a character for each byte
        self.length = np.zeros(max(words.values()) + 1, np.int64)
        self.length[list(words.values())] = [len(w) for w in words]
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at = np.zeros(1, np.uint32), np.array([0, 1])  # run 0 stands for the end of a text
        self.raw, self.raw_at = np.zeros(0, np.uint8), np.zeros(2, np.int64)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """New slots, one for each of the runs data[starts:ends].

        Runs that begin with a lone space or line end and end plainly are encoded end to end, MANY at a time, and cut by
        their tokens' lengths; the others come after them, one by one.
        """
        odd = _MAYBE_SPACE[data]
        plain = (data[starts] == 0x20) | (data[starts] == 0x0A)
        plain &= (ends - starts > 1) & ~odd[np.minimum(starts + 1, len(data) - 1)]
        for back in (1, 2, 3):
            plain &= ~odd[np.maximum(ends - back, starts)] | (ends - back <= starts)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n, size = int(plain.sum()), (ends - starts)[order]
        upto = np.concatenate([[0], np.cumsum(size)])
        raw = data[np.arange(upto[-1]) + np.repeat(starts[order] - upto[:-1], size)]
        ids, count = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for low in range(0, n, MANY):
            high = min(n, low + MANY)
            text = raw[upto[low] : upto[high]].tobytes().decode("utf-8")
            made = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.searchsorted(np.cumsum(self.length[made]), upto[low + 1 : high + 1] - upto[low]) + 1
            ids.append(made)
            count.append(np.diff(cut, prepend=0))
        rest = [raw[a:b].tobytes().decode("utf-8") for a, b in zip(upto[n:-1].tolist(), upto[n + 1 :].tolist(), strict=True)]
        for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            count.append(np.array([len(ids[-1])]))
        slots = np.empty(len(order), np.int64)
        slots[order] = len(self.at) - 1 + np.arange(len(order))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(count))])
        self.flat = np.concatenate([self.flat, *ids])
        self.raw_at = np.concatenate([self.raw_at, self.raw_at[-1] + upto[1:]])
        self.raw = np.concatenate([self.raw, raw])
        return slots

    def _confirmed(self, slot: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """slot, with new slots for runs whose bytes are not those of the run that was learned under their hash."""
        size = ends - starts
        same = self.raw_at[slot + 1] - self.raw_at[slot] == size
        some = np.flatnonzero(same)
        if len(some):
            n = size[some]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = self.raw[np.repeat(self.raw_at[slot[some]], n) + step] == data[np.repeat(starts[some], n) + step]
            same[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        other = np.flatnonzero(~same)
        if len(other):
            slot = slot.copy()
            slot[other] = self._learn(data, starts[other], ends[other])
        return slot

    def ids(self, data: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids with `end` after each text, the offset of each text (one more at last), and ends of sentences."""
        n = len(data)
        lone = np.zeros(n, bool)
        if n > 6:
            odd = _MAYBE_SPACE[data]
            gap = (data[3:-1] == 0x20) | (data[3:-1] == 0x0A)
            lone[3:-1] = gap & ~odd[4:] & ~odd[2:-2] & ~odd[1:-3] & ~odd[:-4]
        if n > 1:
            lone[1:] |= _MARK[data[1:]] & _ASCII_LETTER[data[:-1]]
        lone[off[:-1][off[1:] > off[:-1]]] = True
        starts = np.flatnonzero(lone)
        ends = np.append(starts[1:], n)[: len(starts)]
        hashes = span_hashes(data, starts, ends)
        order = np.argsort(hashes)
        fresh = np.ones(len(order), bool)
        fresh[1:] = hashes[order[1:]] != hashes[order[:-1]]
        unique, first = hashes[order[fresh]], order[fresh]
        if len(self.keys) > MOST_CACHED:
            self.clear()
        have = np.searchsorted(self.keys, unique)
        miss = np.ones(len(unique), bool)
        inside = have < len(self.keys)
        miss[inside] = self.keys[have[inside]] != unique[inside]
        if miss.any():
            new = first[miss]
            slots = self._learn(data, starts[new], ends[new])
            where = np.searchsorted(self.keys, unique[miss])
            self.keys, self.slot = np.insert(self.keys, where, unique[miss]), np.insert(self.slot, where, slots)
        slot = np.empty(len(order), np.int64)
        slot[order] = self.slot[np.searchsorted(self.keys, unique)][np.cumsum(fresh) - 1] if len(order) else 0
        slot = self._confirmed(slot, data, starts, ends)
        stop = _STOP[data[ends - 1]] if n else np.zeros(0, bool)
        if n:
            stop[:-1] |= data[starts[1:]] == 0x0A
        where = np.searchsorted(starts, off[1:])
        slot, stop = np.insert(slot, where, 0), np.insert(stop, where, False)
        at = self.at[slot]
        size = self.at[slot + 1] - at
        upto = np.cumsum(size)
        ids = self.flat[np.repeat(at - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        text_end = upto[where + np.arange(len(where))] if len(where) else np.zeros(0, np.int64)
        ids[text_end - 1] = end
        return ids, np.concatenate([[0], text_end]), upto[stop]


def _merged(*rising: np.ndarray) -> np.ndarray:
    """The distinct values of rising arrays, rising."""
    all_ = np.sort(np.concatenate(rising), kind="stable")
    return all_[np.diff(all_, prepend=-1) != 0]


def cuts(total: int, docs: np.ndarray, sentences: np.ndarray, window: int = WINDOW) -> list[int]:
    """Cheapest cut places of a stream, 0 and total among them. docs, sentences: places where those end, rising."""
    soft = _merged(np.zeros(1, np.int64), docs, sentences, np.array([total]))
    gap = np.diff(soft)
    wide = np.flatnonzero(gap > STRIDE)
    extra = -(-gap[wide] // STRIDE) - 1
    hard = np.repeat(soft[wide], extra) + STRIDE * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    at = _merged(soft, hard)
    fee = np.full(len(at), HARD)
    fee[np.searchsorted(at, sentences)] = SENTENCE
    fee[np.searchsorted(at, np.append(docs, total))] = 0.0
    to, back = [], []  # places that a window of a power of two connects
    for size in (1 << k for k in range(7, 20) if 1 << k < window):
        k = np.searchsorted(at, at - size)
        some = np.flatnonzero((at >= size) & (at[k] == at - size))
        to.append(some)
        back.append(k[some])
    to, back = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (to, back))
    order = np.argsort(to, kind="stable")
    to, back = [*to[order].tolist(), len(at)], back[order].tolist()
    place, fees = at.tolist(), fee.tolist()
    cost, origin = [0.0] * len(place), [0] * len(place)
    queue: deque[int] = deque([0])
    key = [0.0] * len(place)
    nth = 0
    for j in range(1, len(place)):
        p = place[j]
        while p - place[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        best, came = key[i] + window - p, i
        while to[nth] == j:
            k = back[nth]
            nth += 1
            if cost[k] < best:
                best, came = cost[k], k
        cost[j] = best = best + fees[j]
        origin[j] = came
        key[j] = k = best + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out, j = [], len(place) - 1
    while j:
        out.append(place[j])
        j = origin[j]
    return [0, *out[::-1]]


_CUTTERS: dict[str, Cutter] = {}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: its document, place there, crc32 of its ids, sequence and place in it.

    vocabulary is the path, on every executor, of a byte-level tokenizer's file.
    sequence_id is the task's number times 2^40 plus a count. with_ids adds the ids themselves (array<int>).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _CUTTERS:
            _CUTTERS[vocabulary] = Cutter(vocabulary)
        cutter = _CUTTERS[vocabulary]
        sequence = TaskContext.get().partitionId() << 40
        ids, held = np.zeros(0, np.uint32), [np.zeros(0, np.int64)] * 2  # held: ends of documents, of sentences
        names: list = []
        sizes: list[int] = []
        skip = 0  # ids of the first held document that earlier sequences have

        def emit(last: bool) -> pa.RecordBatch | None:
            nonlocal ids, held, names, sizes, skip, sequence
            if not len(ids):
                return None
            edge = cuts(len(ids), held[0], held[1], window)
            if not last:
                edge = edge[:-1]
            if len(edge) < 2:
                return None
            edge = np.array(edge)
            stop = edge[-1]
            begin = _merged(edge[:-1], held[0][held[0] < stop])
            length = np.diff(np.append(begin, stop))
            of = np.searchsorted(held[0], begin, "right")
            seq = np.searchsorted(edge, begin, "right") - 1
            first = np.concatenate([[-skip], held[0][:-1]])
            raw = memoryview(ids.astype("<u4").tobytes())
            out = {
                "doc_id": pa.array([names[i] for i in of.tolist()], pa.int64()), "start": pa.array(begin - first[of]), "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)], pa.int64()),
                "doc_tokens": pa.array(np.array(sizes)[of]), "sequence_id": pa.array(seq + sequence), "offset": pa.array(begin - edge[seq]),
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, stop).astype(np.int32)), pa.array(ids.astype(np.int32)))
            sequence += len(edge) - 1
            gone = int(np.searchsorted(held[0], stop, "right"))
            skip = int(stop - (held[0][gone - 1] if gone else -skip)) if gone < len(names) else 0
            names, sizes, ids = names[gone:], sizes[gone:], ids[stop:]
            held = [x[x > stop] - stop for x in held]
            return pa.record_batch(out)

        for batch in pieces(batches, "text", PIECE):
            more, bounds, sentence = cutter.ids(*text_bytes(batch.column("text")), end_id)
            held = [np.concatenate([held[0], bounds[1:] + len(ids)]), np.concatenate([held[1], sentence + len(ids)])]
            names += batch.column("doc_id").to_pylist()
            sizes += np.diff(bounds).tolist()
            ids = np.concatenate([ids, more])
            if len(ids) >= block and (made := emit(False)):
                yield made
        if made := emit(True):
            yield made

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
