"""Removal of repeated passages, found by sharded Aho-Corasick automata.

A window is WINDOW consecutive words of one text. The steps:

1. All windows of all texts are hashed; as 32-bit values within hash fragments they meet once, and each text learns
   which of its windows may occur elsewhere. A collision can only add some; nothing that recurs is lost.
2. Stretches of such windows are cut where the window's minimizer (its least three-word hash) changes, so that equal
   windows always come to the same shard. Equal stretches of one task's batch travel once.
3. A shard confirms which windows recur, compiles them into an automaton over its words, and runs every stretch
   through it: each match is an occurrence, and the earliest one of each window is its first.
4. Each text drops the words of all windows that start earlier elsewhere, judged on the input.

Texts are ordered by doc_id, places within one by word. Defined cases: a null text has no words; a text of fewer than
WINDOW words has no window; rows with a null id come after all others; rows that share an id count as one document
(the same place in it is not earlier); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm._bytes import mix, pieces, span_hashes, text_bytes, window_hashes, within, words
from tagweave.llm._squeeze import expand, fragment_count, runs, squeeze
from tagweave.llm._store import written

WINDOW, GRAM = 20, 3
PIECE, SLICE = 4 << 20, 1 << 19
SHARD_WINDOWS = 150_000
LAST = (1 << 63) - 1
_U = np.uint64


def _numbers() -> Iterator[int]:
    from pyspark import TaskContext

    n = TaskContext.get().partitionId() << 32
    while True:
        yield n
        n += 1


def _ranges(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    edge = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(0, int)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(part[a]), slice(a, b)


def kept_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, upto: np.ndarray, keep: np.ndarray) -> list[str]:
    """SHA-256 of each text's kept words, joined by one space."""
    size = np.where(keep, ends - starts + 1, 0)
    total = np.concatenate([[0], np.cumsum(size)])
    out = np.full(total[-1], 0x20, np.uint8)
    some = np.flatnonzero(keep)
    length = (ends - starts)[some]
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(total[some], length) + step] = data[np.repeat(starts[some], length) + step]
    raw = memoryview(out.tobytes())
    return [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(total[upto[:-1]].tolist(), total[upto[1:]].tolist(), strict=True)]


_FOUND = "f int, b long, keys array<long>, ids array<long>, shas array<string>, n binary, a binary, c binary"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["f", "b", "keys", "ids", "shas", "n", "a", "c"])


def _listed(table: pa.Table) -> list[tuple]:
    return list(zip(*(table.column(i).to_pylist() for i in range(table.num_columns)), strict=True))


def recurring(docs: DataFrame, window: int = WINDOW, fragments: int | None = None) -> DataFrame:
    """docs (key, doc_id, text) -> (key, doc_id, n_words, sha, stretches) of every row: where windows may occur elsewhere too."""
    fragments = fragments or fragment_count(docs)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, batch in zip(_numbers(), pieces(batches, "text", PIECE)):
            parts, shas, sizes = [], [], []
            for piece in pieces([batch], "text", SLICE):  # what is needed on the way does not add up over the batch
                data, off = text_bytes(piece.column("text"))
                starts, ends, upto = words(data, off)
                parts.append(window_hashes(span_hashes(data, starts, ends), window)[within(upto, window)[0]])
                shas += kept_digests(data, starts, ends, upto, np.ones(len(starts), bool))
                sizes.append(np.diff(upto))
            gram = np.concatenate(parts)
            order, begin, _ = runs(gram)
            length = np.diff(np.append(begin, len(order)))
            here = np.sort(order[np.repeat(length > 1, length)])
            rows = [(b % fragments, b, batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), shas, squeeze(np.concatenate(sizes)), squeeze(here, True), None)]
            lead = order[begin]
            part, low = ((gram[lead] >> _U(40)) % _U(fragments)).astype(np.int64), gram[lead].astype(np.uint32)
            order = np.argsort((part.astype(_U) << _U(32)) | low)
            part, low, lead = part[order], low[order], lead[order]
            rows += [(f, b, None, None, None, None, squeeze(low[s], True), squeeze(lead[s])) for f, s in _ranges(part)]
            yield _found(rows)

    def meet(table: pa.Table) -> pa.Table:
        rows = _listed(table)
        out = [r for r in rows if r[2] is not None]
        rows = [r for r in rows if r[2] is None]
        if rows:
            low, who = [expand(r[6], True) for r in rows], [expand(r[7]) for r in rows]
            of = np.repeat(np.arange(len(rows)), [len(x) for x in low])
            low, who = np.concatenate(low), np.concatenate(who)
            order, begin, _ = runs(low)
            length = np.diff(np.append(begin, len(order)))
            again = np.sort(order[np.repeat(length > 1, length)])
            for i, s in _ranges(of[again]):
                out.append((rows[i][0], rows[i][1], None, None, None, None, squeeze(np.sort(who[again[s]]), True), None))
        return pa.Table.from_batches([_found(out)]) if out else table.slice(0, 0)

    def gather(table: pa.Table) -> pa.Table:
        rows = _listed(table)
        made = []
        for r in rows:
            if r[2] is None:
                continue
            size = expand(r[5]).astype(np.int64)
            count = np.maximum(size - window + 1, 0)
            flag = np.zeros(int(count.sum()), bool)
            for x in rows:
                flag[expand(x[6], True)] = True
            owner = np.repeat(np.arange(len(size)), count)
            place = np.arange(len(flag)) - (np.cumsum(count) - count)[owner]
            at = np.flatnonzero(flag)
            head = np.ones(len(at), bool)
            head[1:] = (np.diff(at) > 1) | (np.diff(owner[at]) != 0)
            tail = np.append(head[1:], True)[: len(at)]
            pairs = pa.StructArray.from_arrays([pa.array(place[at[head]].astype(np.int32)), pa.array(place[at[tail]].astype(np.int32))], ["a", "b"])
            edge = np.concatenate([[0], np.cumsum(np.bincount(owner[at[head]], minlength=len(size)))]).astype(np.int32)
            made.append(pa.table({"key": pa.array(r[2], pa.int64()), "doc_id": pa.array(r[3], pa.int64()), "n_words": size, "sha": pa.array(r[4], pa.string()), "stretches": pa.ListArray.from_arrays(pa.array(edge), pairs)}))
        return pa.concat_tables(made)

    met = docs.mapInArrow(ship, _FOUND).groupBy("f").applyInArrow(meet, _FOUND)
    return met.groupBy("b").applyInArrow(gather, "key long, doc_id long, n_words long, sha string, stretches array<struct<a:int,b:int>>")


def minimizers(word: np.ndarray, window: int, gram: int = GRAM) -> np.ndarray:
    """The place of the least hash of `gram` words in the window at each word (the first one on a tie).

    A place takes the low 24 bits beside the hash, so longer inputs go in pieces that overlap by a window.
    """
    most = 1 << 24
    if len(word) > most:
        return np.concatenate([minimizers(word[at : at + most], window, gram) + at for at in range(0, len(word) - window + 1, most - window + 1)])
    order = (window_hashes(word, gram) & _U(0xFFFFFFFFFF000000)) | np.arange(max(0, len(word) - gram + 1), dtype=_U)
    span, have = window - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        order = np.minimum(order[:-step], order[step:])
        have += step
    return (order & _U(0xFFFFFF)).astype(np.int64)


_SENT = "g int, b long, sid int, text binary, times int, ord long, start int, keys array<long>, occ binary"


def first_places(table: pa.Table, window: int = WINDOW) -> tuple[list[bytes | None], list[list[int]]]:
    """A shard's stretches (text, times, ord, start): for each distinct one the rows that have it and, in runs, where its windows occur first.

    A stretch none of whose windows stands anywhere else in the shard's distinct stretches is one pattern as a whole;
    of the others, each recurring window is one.
    """
    import ahocorasick

    texts = table.column("text").combine_chunks()
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    data, off = text_bytes(texts.cast(pa.binary()))
    starts, ends, upto = words(data, off)
    names = np.unique(span_hashes(data, starts, ends), return_inverse=True)[1].astype(np.int32)
    order, place, times = table.column("ord").to_pylist(), table.column("start").to_pylist(), table.column("times").to_numpy()
    stretch: dict[bytes, list[int]] = {}
    raw, cut = names.tobytes(), (upto * 4).tolist()
    for i in range(len(order)):
        stretch.setdefault(raw[cut[i] : cut[i + 1]], []).append(i)
    line = [np.frombuffer(k, np.int32) for k in stretch]
    rows = list(stretch.values())
    early = [min((order[i], place[i]) for i in r) for r in rows]
    bound = np.concatenate([[0], np.cumsum([len(x) for x in line])])
    flat = np.concatenate(line)
    first, owner = within(bound, window)
    key = window_hashes(mix(flat.astype(_U) + _U(1)), window)[first]
    seen, begin, run = runs(key)
    places = np.diff(np.append(begin, len(seen)))
    several = np.array([times[r].sum() for r in rows], np.int64)
    shared = np.zeros(len(line), bool)
    shared[owner[seen[np.repeat(places > 1, places)]]] = True
    whole = np.flatnonzero(~shared & (several > 1))
    again = np.add.reduceat(several[owner[seen]], begin) > 1
    single = seen[begin[again & shared[owner[seen[begin]]]]]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for x in whole.tolist():
        automaton.add_word(tuple(line[x].tolist()), x)
    base = len(line)
    for n, w in enumerate(single.tolist()):
        automaton.add_word(tuple(flat[first[w] : first[w] + window].tolist()), base + n)
    found: list[bytes | None] = [None] * base
    if not len(automaton):
        return found, rows
    automaton.make_automaton()
    best = [(LAST, 0)] * len(single)
    hits: dict[int, list[tuple[int, int]]] = {}
    for x in np.flatnonzero(shared | (several > 1)).tolist():
        o, at = early[x]
        own = []
        for end, p in automaton.iter(tuple(line[x].tolist())):
            if p < base:
                found[p] = np.array([0, len(line[p]) - window + 1, *early[p]], np.int64).tobytes()
            else:
                j = end - window + 1
                own.append((j, p - base))
                if (o, at + j) < best[p - base]:
                    best[p - base] = (o, at + j)
        if own:
            hits[x] = own
    for x, own in hits.items():
        j, p = np.array(own, np.int64).T
        o, at = np.array([best[i] for i in p.tolist()], np.int64).T
        shift = at - j
        head = np.flatnonzero((np.diff(j, prepend=-9) != 1) | (np.diff(o, prepend=-1) != 0) | (np.diff(shift, prepend=LAST) != 0))
        found[x] = np.stack([j[head], np.diff(np.append(head, len(j))), o[head], at[head]]).tobytes()
    return found, rows


def removals(texts: DataFrame, shards: int, window: int = WINDOW) -> DataFrame:
    """texts (key, doc_id, text, stretches) -> (key, id, gone), id being LAST for a null doc_id: ranges of words to remove, from and to by turns."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        names = ["g", "b", "sid", "text", "times", "ord", "start", "keys", "occ"]
        for b, batch in zip(_numbers(), pieces(batches, "text", PIECE)):
            data, off = text_bytes(batch.column("text"))
            starts, ends, upto = words(data, off)
            word = span_hashes(data, starts, ends)
            lists = batch.column("stretches")
            flat, of = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            a, z = (flat.field(i).to_numpy().astype(np.int64) + upto[of] for i in (0, 1))
            count = z - a + 1
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
            if not len(at):
                continue
            owner = np.repeat(of, count)
            least = minimizers(word, window)[at]
            head = np.ones(len(at), bool)
            head[1:] = (np.diff(at) != 1) | (np.diff(least) != 0) | (np.diff(owner) != 0)
            begin = np.flatnonzero(head)
            w0, n = at[begin], np.diff(np.append(begin, len(at)))
            power = np.cumprod(np.full(len(word) + 1, 0x9E3779B97F4A7C15, _U))
            back = np.cumprod(np.full(len(word) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), _U))
            total = np.concatenate([np.zeros(1, _U), np.cumsum(word * power[: len(word)])])
            same = mix((total[w0 + n + window - 1] - total[w0]) * back[w0] + n.astype(_U))
            order, lead, run = runs(same)
            sid = np.empty(len(same), np.int64)
            sid[order] = run
            ids = batch.column("doc_id")
            ids = ids.fill_null(LAST).to_numpy()
            where = w0 - upto[owner[begin]]
            by_place = np.lexsort((where, ids[owner[begin]], sid))
            one = by_place[np.flatnonzero(np.diff(sid[by_place], prepend=-1))]
            shard = (mix(window_hashes(word, GRAM)[least[begin[one]]]) % _U(shards)).astype(np.int32)
            raw = data.tobytes()
            text = [raw[s:e] for s, e in zip(starts[w0[one]].tolist(), ends[w0[one] + n[one] + window - 2].tolist(), strict=True)]
            head_row = [pa.array([v], k) for v, k in zip((b % shards, b, None, None, None, None, None, batch.column("key").to_pylist(), np.stack([owner[begin], where, sid, ids[owner[begin]]]).tobytes()), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(head_row, names)
            m = len(one)
            columns = [shard, np.full(m, b), sid[one].astype(np.int32), text, np.bincount(sid).astype(np.int32), ids[owner[begin[one]]], where[one].astype(np.int32), [None] * m, [None] * m]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names)

    def locate(table: pa.Table) -> pa.Table:
        is_head = table.column("keys").is_valid()
        head, body = table.filter(is_head), table.filter(pa.compute.invert(is_head))
        out = [head.select(["b", "keys", "occ"]).append_column("sid", pa.nulls(len(head), pa.int32())).append_column("found", pa.nulls(len(head), pa.binary()))]
        if len(body):
            found, rows = first_places(body, window)
            batch, sid = body.column("b").to_pylist(), body.column("sid").to_pylist()
            made = [(batch[i], sid[i], raw) for raw, own in zip(found, rows, strict=True) if raw for i in own]
            if made:
                bs, ss, raws = zip(*made, strict=True)
                out.append(pa.table({"b": pa.array(bs, pa.int64()), "keys": pa.nulls(len(bs), pa.list_(pa.int64())), "occ": pa.nulls(len(bs), pa.binary()), "sid": pa.array(ss, pa.int32()), "found": pa.array(raws, pa.binary())}))
        return pa.concat_tables([t.select(["b", "keys", "occ", "sid", "found"]).cast(_VERDICT) for t in out])

    def gather(table: pa.Table) -> pa.Table:
        is_head = table.column("keys").is_valid()
        head, body = table.filter(is_head), table.filter(pa.compute.invert(is_head))
        sids, raws = body.column("sid").to_numpy(), body.column("found").to_pylist()
        runs_ = [np.frombuffer(r, np.int64).reshape(4, -1) for r in raws]
        many = np.array([x.shape[1] for x in runs_], np.int64)
        all_runs = np.concatenate(runs_, axis=1) if runs_ else np.zeros((4, 0), np.int64)
        run_sid = np.repeat(sids.astype(np.int64), many)
        order = np.argsort(run_sid, kind="stable")
        run_sid, all_runs = run_sid[order], all_runs[:, order]
        keys_out, ids_out, gone_out = [], [], []
        for keys, raw in zip(head.column("keys").to_pylist(), head.column("occ").to_pylist(), strict=True):
            owner, where, sid, ids = np.frombuffer(raw, np.int64).reshape(4, -1)
            low, high = np.searchsorted(run_sid, sid, "left"), np.searchsorted(run_sid, sid, "right")
            n = high - low
            of = np.repeat(np.arange(len(sid)), n)
            r = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]
            j, length, first_ord, first_at = all_runs[:, r]
            at = where[of] + j
            earlier = (first_ord < ids[of]) | (first_ord == ids[of]) & (first_at < at)
            doc, a, z = owner[of[earlier]], at[earlier], (at + length + window - 1)[earlier]
            order = np.lexsort((a, doc))
            for d, s in _ranges(doc[order]):
                a_, z_ = a[order][s], np.maximum.accumulate(z[order][s])
                new = np.flatnonzero(np.concatenate([[True], a_[1:] > z_[:-1]]))
                keys_out.append(keys[d])
                ids_out.append(int(ids[np.searchsorted(owner, d)]))
                gone_out.append(np.stack([a_[new], z_[np.append(new[1:], len(a_)) - 1]], axis=1).ravel().tolist())
        return pa.table({"key": pa.array(keys_out, pa.int64()), "id": pa.array(ids_out, pa.int64()), "gone": pa.array(gone_out, pa.list_(pa.int32()))})

    met = texts.mapInArrow(ship, _SENT).groupBy("g").applyInArrow(locate, "b long, keys array<long>, occ binary, sid int, found binary")
    return met.groupBy("b").applyInArrow(gather, "key long, id long, gone array<int>")


_VERDICT = pa.schema([("b", pa.int64()), ("keys", pa.list_(pa.int64())), ("occ", pa.binary()), ("sid", pa.int32()), ("found", pa.binary())])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE):
        data, off = text_bytes(batch.column("text"))
        starts, ends, upto = words(data, off)
        keep = np.ones(len(starts), bool)
        for i, gone in enumerate(batch.column("gone").to_pylist()):
            for a, z in zip(gone[::2], gone[1::2], strict=True):
                keep[upto[i] + a : upto[i] + z] = False
        shas = kept_digests(data, starts, ends, upto, keep)
        removed = np.diff(np.concatenate([[0], np.cumsum(~keep)])[upto])
        yield pa.record_batch({"key": batch.column("key"), "id": batch.column("id"), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(shas, pa.string())})


def dedup(docs: DataFrame, window: int = WINDOW, fragments: int | None = None, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256), a row for each row.

    Rows are told apart by their id and a hash of it and the text together; equal rows have equal results.
    """
    id_ = F.coalesce("doc_id", F.lit(LAST)).alias("id")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    found = written(recurring(rows, window, fragments), "recurring").withColumn("id", id_)
    some = found.where(F.size("stretches") > 0).select("key", "id", "stretches").dropDuplicates(["key", "id"])
    texts = written(rows.withColumn("id", id_).join(some, ["key", "id"]), "texts")
    total = some.agg(F.sum(F.expr("aggregate(stretches, 0L, (n, x) -> n + x.b - x.a + 1)")).alias("n")).first()["n"] or 0
    gone = removals(texts, max(1, -(-total // shard_windows)), window).dropDuplicates(["key", "id"])
    cut = texts.select("key", "id", "text").join(gone, ["key", "id"]).mapInArrow(_without, "key long, id long, n_removed long, kept string").dropDuplicates(["key", "id"])
    out = found.join(cut, ["key", "id"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))
