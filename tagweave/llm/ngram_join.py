"""Jaccard self-join on word n-grams by vertical partitioning, and the groups that its links make.

The n-grams of the corpus have a global order: by class of document frequency, then by hash. The order is cut into
fragments; documents' sets are cut along, overlaps are counted fragment by fragment, and sums per pair give the exact
overlap. The steps:

1. Sets, sizes and fingerprints of all texts. N-grams, as 32-bit values within hash fragments, meet once, so that each
   document learns how many of its n-grams no other document has. A collision can only lower that number. A document
   with more than a fifth of such n-grams can have no partner and is done.
2. Equal sets make one class. The classes left get exact document frequencies, and with them the global order. Two
   linked sets share an n-gram among the rarest fifth of each (prefix filter), at places that leave room enough for
   the overlap (positional filter).
3. Before sets are compared, their counts in cells by hash must leave room for the overlap too. Every class is
   compared with the class that most often leads the lists of its rare n-grams (the one least far down its own order).
   Links make components. Then, within a list, all pairs of different components that pass the
   filters are compared: whatever could still join two components is looked at.
4. All links lie within components. Their numbers are counted there in blocks of classes: the blocks' n-grams are cut
   into the same fragments, partial overlaps of all pairs are matrix products, and their sum decides. Pairs are not
   listed, so a group of thousands of near copies costs their comparisons but no rows.

Defined cases: a null or empty text, or one without words, has no n-grams and links with nothing; a text of fewer than
n words is one n-gram; rows with a null id count like others but name no component; rows that share an id are
separate documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm._bytes import lowered, mix, pieces, span_hashes, text_bytes, window_hashes, within, words
from tagweave.llm._graph import components
from tagweave.llm._squeeze import expand, fragment_count, runs, squeeze
from tagweave.llm._store import drop_written, written

N = 5
PIECE, SLICE = 4 << 20, 1 << 19
MANY = np.uint32(0xFFFFFFFF)
CLASSES = 12
SPREAD = 128
ROWS, GRAMS, COLUMNS = 512, 1 << 19, 1024
_U = np.uint64


def ngram_sets(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's distinct n-grams with the text's number, texts in order; and counts a text."""
    data = lowered(data)
    starts, ends, at = words(data, off)
    word = span_hashes(data, starts, ends)
    first, owner = within(at, n)
    grams = [window_hashes(word, n)[first]]
    owners = [owner]
    size = np.diff(at)
    for few in range(1, n):
        some = np.flatnonzero(size == few)
        if len(some):
            grams.append(mix(window_hashes(word, few)[at[some]] + _U(few)))
            owners.append(some)
    gram, owner = np.concatenate(grams), np.concatenate(owners)
    if len(owners) > 1:
        order = np.argsort(owner, kind="stable")
        gram, owner = gram[order], owner[order]
    order, begin, _ = runs(gram)
    length = np.diff(np.append(begin, len(order)))
    again = np.repeat(length > 1, length)
    twice = order[again]
    twice = twice[np.lexsort((owner[twice], gram[twice]))]
    same = (gram[twice[1:]] == gram[twice[:-1]]) & (owner[twice[1:]] == owner[twice[:-1]])
    keep = np.ones(len(gram), bool)
    keep[twice[1:][same]] = False
    gram, owner = gram[keep], owner[keep]
    return gram, owner, np.bincount(owner, minlength=len(off) - 1)


def _sets_of(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ngram_sets of a batch, made from slices of it, so that what they need on the way does not add up."""
    made, at = [], 0
    for part in pieces([batch], "text", SLICE):
        gram, owner, count = ngram_sets(*text_bytes(part.column("text")), n)
        made.append((gram, owner + at, count))
        at += part.num_rows
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def _fingerprints(gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    begin = np.cumsum(count) - count
    some = np.flatnonzero(count)
    for salt in (1, 2):
        print_ = np.zeros(len(count), _U)
        if len(some):
            print_[some] = np.add.reduceat(mix(gram + _U(salt)), begin[some])
        out.append(mix(print_).view(np.int64))
    return out[0], out[1]


def _batch_numbers() -> Iterator[int]:
    n = TaskContext.get().partitionId() << 32
    while True:
        yield n
        n += 1


def _split(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Value and range of each run of a sorted array."""
    edge = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(0, int)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(part[a]), slice(a, b)


_SHIPPED = "f int, b long, ids array<long>, n binary, fp binary, a binary, c binary"


def _row(f: int, b: int, ids: list | None = None, n: bytes | None = None, fp: bytes | None = None, a: bytes | None = None, c: bytes | None = None) -> tuple:
    return f, b, ids, n, fp, a, c


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["f", "b", "ids", "n", "fp", "a", "c"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _rows_of(table: pa.Table) -> list[tuple]:
    return list(zip(*(table.column(i).to_pylist() for i in range(table.num_columns)), strict=True))


def document_sizes(docs: DataFrame, n: int = N, fragments: int = 1) -> DataFrame:
    """(doc_id, n, fp1, fp2, alive) of every row: set size, fingerprint, and whether a partner is possible at all."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, batch in zip(_batch_numbers(), pieces(batches, "text", PIECE)):
            gram, owner, count = _sets_of(batch, n)
            one, two = _fingerprints(gram, count)
            rows = [_row(b % fragments, b, batch.column("doc_id").to_pylist(), squeeze(count), np.stack([one, two]).tobytes())]
            order, begin, _ = runs(gram)
            length = np.diff(np.append(begin, len(order)))
            lead = order[begin]
            who = np.where(length > 1, MANY, owner[lead].astype(np.uint32))
            part, low = ((gram[lead] >> _U(40)) % _U(fragments)).astype(np.int64), gram[lead].astype(np.uint32)
            order = np.argsort((part.astype(_U) << _U(32)) | low)
            part, low, who = part[order], low[order], who[order]
            rows += [_row(f, b, a=squeeze(low[s], True), c=squeeze(who[s])) for f, s in _split(part)]
            yield _record(rows)

    def alone(table: pa.Table) -> pa.Table:
        """Of each batch's n-grams in this fragment, how many a document holds that no other has."""
        rows = _rows_of(table)
        out = [r for r in rows if r[2] is not None]
        rows = [r for r in rows if r[2] is None]
        if rows:
            low, who = [expand(r[5], True) for r in rows], [expand(r[6]) for r in rows]
            of = np.repeat(np.arange(len(rows)), [len(x) for x in low])
            low, who = np.concatenate(low), np.concatenate(who)
            order, begin, _ = runs(low)
            lead = order[begin[np.diff(np.append(begin, len(order))) == 1]]
            lead = np.sort(lead[who[lead] != MANY])
            for i, s in _split(of[lead]):
                names, times = np.unique(who[lead[s]], return_counts=True)
                out.append(_row(rows[i][0], rows[i][1], a=squeeze(names, True), c=squeeze(times)))
        return pa.Table.from_batches([_record(out)]) if out else table.slice(0, 0)

    def gather(table: pa.Table) -> pa.Table:
        rows = _rows_of(table)
        made = []
        for r in rows:
            if r[2] is None:
                continue
            count = expand(r[3]).astype(np.int64)
            own = np.zeros(len(count), np.int64)
            for x in rows:
                if x[2] is None:
                    own[expand(x[5], True)] += expand(x[6])
            prints = np.frombuffer(r[4], np.int64).reshape(2, -1)
            made.append(pa.table({"doc_id": pa.array(r[2], pa.int64()), "n": count, "fp1": prints[0], "fp2": prints[1], "alive": (count > 0) & (5 * (count - own) >= 4 * count)}))
        return pa.concat_tables(made)

    met = docs.select("doc_id", "text").mapInArrow(ship, _SHIPPED).groupBy("f").applyInArrow(alone, _SHIPPED)
    return met.groupBy("b").applyInArrow(gather, "doc_id long, n long, fp1 long, fp2 long, alive boolean")


_PREFIXES = "key long, n long, prefix array<struct<gram:long,pos:long>>, parts array<struct<part:int,grams:array<long>>>, spread array<int>"


def global_order(texts: DataFrame, fragments: int, n: int = N) -> DataFrame:
    """texts (key, fp1, fp2, text), one row a class -> its rare n-grams with their places in the global order, and its set cut along that order.

    Only n-grams that two classes or more share are listed; the others come first in the order and meet nothing.
    """

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, batch in zip(_batch_numbers(), pieces(batches, "text", PIECE)):
            gram, owner, count = _sets_of(batch, n)
            one, two = _fingerprints(gram, count)
            mine = (one == batch.column("fp1").to_numpy()) & (two == batch.column("fp2").to_numpy())  # another row of that id may have another text
            rows = [_row(b % fragments, b, batch.column("key").to_pylist(), squeeze(np.where(mine, count, 0)))]
            gram, owner = gram[mine[owner]], owner[mine[owner]]
            part = ((gram >> _U(40)) % _U(fragments)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows += [_row(f, b, a=gram[order[s]].tobytes(), c=squeeze(owner[order[s]], True)) for f, s in _split(part[order])]
            yield _record(rows)

    def frequencies(table: pa.Table) -> pa.Table:
        rows = _rows_of(table)
        out = [r for r in rows if r[2] is not None]
        rows = [r for r in rows if r[2] is None]
        if rows:
            grams = [np.frombuffer(r[5], _U) for r in rows]
            gram = np.concatenate(grams)
            order, begin, run = runs(gram)
            times = np.empty(len(gram), np.int64)
            times[order] = np.diff(np.append(begin, len(order)))[run]
            at = 0
            for r, own in zip(rows, grams, strict=True):
                df = times[at : at + len(own)]
                at += len(own)
                shared = df > 1
                if shared.any():
                    out.append(_row(r[0], r[1], n=squeeze(np.minimum(df[shared], 1 << 30)), a=own[shared].tobytes(), c=squeeze(expand(r[6], True)[shared], True)))
        return pa.Table.from_batches([_record(out)]) if out else table.slice(0, 0)

    def place(table: pa.Table) -> pa.Table:
        rows = _rows_of(table)
        made = []
        for r in rows:
            if r[2] is None:
                continue
            others = [x for x in rows if x[2] is None]
            size = expand(r[3]).astype(np.int64)
            gram = np.concatenate([np.frombuffer(x[5], _U) for x in others] or [np.zeros(0, _U)])
            owner = np.concatenate([expand(x[6], True) for x in others] or [np.zeros(0, np.uint32)]).astype(np.int64)
            df = np.concatenate([expand(x[3]) for x in others] or [np.zeros(0, np.uint32)])
            shared = np.bincount(owner, minlength=len(size))
            hope = (size > 0) & (5 * shared >= 4 * size)
            gram, owner, df = gram[hope[owner]], owner[hope[owner]], df[hope[owner]]
            level = np.minimum(np.log2(np.maximum(df, 1)).astype(np.int64), CLASSES - 1)
            order = np.lexsort((gram, level, owner))
            gram, owner, level = gram[order], owner[order], level[order]
            count = np.where(hope, shared, 0)
            pos = np.arange(len(owner)) - (np.cumsum(count) - count)[owner] + (size - shared)[owner]
            rare = pos < (size - -(-4 * size // 5) + 1)[owner]
            part = level * 4 + (gram >> _U(62)).astype(np.int64)
            edge = np.flatnonzero(np.diff(owner * 64 + part, prepend=-1)) if len(owner) else np.zeros(0, np.int64)
            some = np.flatnonzero(hope)
            signed = pa.array(gram.view(np.int64))
            prefix = pa.StructArray.from_arrays([pa.array(gram[rare].view(np.int64)), pa.array(pos[rare])], ["gram", "pos"])
            cut = pa.StructArray.from_arrays([pa.array(part[edge].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(edge, len(gram)).astype(np.int32)), signed)], ["part", "grams"])
            bounds = [np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(size))[some])]).astype(np.int32) for x in (owner[rare], owner[edge])]
            keys = pa.array([r[2][i] for i in some.tolist()], pa.int64())
            cell = np.bincount(owner * SPREAD + (gram >> _U(32)).astype(np.int64) % SPREAD, minlength=len(size) * SPREAD).reshape(-1, SPREAD)[some]
            spread = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * SPREAD), pa.array(cell.astype(np.int32).ravel()))
            made.append(pa.table({"key": keys, "n": size[some], "prefix": pa.ListArray.from_arrays(pa.array(bounds[0]), prefix), "parts": pa.ListArray.from_arrays(pa.array(bounds[1]), cut), "spread": spread}))
        return pa.concat_tables(made)

    met = texts.select("key", "fp1", "fp2", "text").mapInArrow(ship, _SHIPPED).groupBy("f").applyInArrow(frequencies, _SHIPPED)
    return met.groupBy("b").applyInArrow(place, _PREFIXES)


def _room(a: str, b: str) -> str:
    """Whether a first common n-gram at these places leaves room for the overlap that a link needs."""
    return f"9 * (1 + least({a}.n - {a}.pos - 1, {b}.n - {b}.pos - 1)) >= 4 * ({a}.n + {b}.n)"


def hopeful(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Those pairs that could be links by the number of n-grams they have in each of SPREAD cells by hash."""
    cells = order.select("key", "spread")
    both = pairs.join(cells.select(F.col("key").alias("a"), F.col("spread").alias("sa")), "a").join(cells.select(F.col("key").alias("b"), F.col("spread").alias("sb")), "b")
    most = F.expr("aggregate(zip_with(sa, sb, (x, y) -> int(least(x, y))), 0, (s, x) -> s + x)")
    return both.where(9 * most >= 4 * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """pairs (a, b, na, nb) that are links: overlaps are counted in each fragment and summed per pair."""
    left = pairs.join(parts.select(F.col("key").alias("a"), "part", F.col("grams").alias("ga")), "a")
    both = left.join(parts.select(F.col("key").alias("b"), "part", F.col("grams").alias("gb")), ["b", "part"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("partial"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("overlap")).where("9 * overlap >= 4 * (na + nb)").select("a", "b")


def _block_links(table: pa.Table) -> pa.Table:
    """Links of each class of a block (component, p, q): overlaps of all its pairs, fragment by fragment, summed."""
    block = np.stack([table.column(c).to_numpy() for c in ("component", "p", "q")])
    own, key, n, copies = (table.column(c).to_numpy() for c in ("own", "key", "n", "copies"))
    lists = table.column("parts").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat, sets = lists.flatten(), lists.flatten().field(1)
    gram = sets.flatten().to_numpy()
    per_list, per_set = lists.value_lengths().to_numpy(), sets.value_lengths().to_numpy()
    part = np.repeat(flat.field(0).to_numpy(), per_set)
    list_end, set_end = np.cumsum(per_list), np.concatenate([[0], np.cumsum(per_set)])
    end = set_end[list_end]
    begin = np.concatenate([[0], end[:-1]])
    order = np.lexsort(block[::-1])
    edge = np.flatnonzero((np.diff(block[:, order], axis=1, prepend=-1) != 0).any(0)) if len(order) else np.zeros(0, np.int64)
    out_key, out_n = [], []
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist(), strict=True):
        at = order[a:b]
        size = (end - begin)[at]
        where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[at], size)
        _, first, column, times = np.unique(gram[where], return_index=True, return_inverse=True, return_counts=True)
        fragment, row = part[where][first], np.repeat(np.arange(len(at)), size)
        overlap = np.full((len(at), len(at)), (times == len(at)).sum(), np.float32)
        some = np.flatnonzero((times > 1) & (times < len(at)))
        some = some[np.argsort(fragment[some], kind="stable")]
        place = np.full(len(times), -1)
        place[some] = np.arange(len(some))
        to = place[column]
        row, to = row[to >= 0], to[to >= 0]
        by = np.argsort(to, kind="stable")
        row, to = row[by], to[by]
        for _, s in _split(fragment[some]):
            for low in range(s.start, s.stop, COLUMNS):
                high = min(s.stop, low + COLUMNS)
                i, j = np.searchsorted(to, [low, high])
                x = np.zeros((len(at), high - low), np.float32)
                x[row[i:j], to[i:j] - low] = 1
                overlap += x @ x.T
        linked = 9 * overlap.astype(np.float64) >= 4 * (n[at][:, None] + n[at][None, :])
        np.fill_diagonal(linked, False)
        if block[1, at[0]] != block[2, at[0]]:
            linked &= own[at][:, None] != own[at][None, :]
        out_key.append(key[at])
        out_n.append(linked @ copies[at])
    if not out_key:
        return pa.table({"key": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    return pa.table({"key": np.concatenate(out_key), "links": np.concatenate(out_n).astype(np.int64)})


def link_counts(order: DataFrame, groups: DataFrame, copies: DataFrame, rows: int = ROWS, grams: int = GRAMS) -> DataFrame:
    """(key, links): the documents of other classes that each class links with.

    Links lie within components. A component's classes are dealt by hash into blocks of about `rows` classes and
    `grams` n-grams; each pair of blocks is one piece of work, whatever task it falls to, and no pair is listed.
    Two classes that make a component are linked.
    """
    all_ = order.select("key", "n", "parts").join(groups.select(F.col("node").alias("key"), "component"), "key").join(copies, "key")
    size = all_.groupBy("component").agg(F.count("*").alias("k"), F.sum("copies").alias("all"), F.sum("n").alias("grams"))
    all_ = written(all_, "members")
    many = written(size.where("k > 2").withColumn("blocks", F.greatest(F.ceil(F.col("k") / rows), F.ceil(F.col("grams") / grams)).cast("int")), "blocks")
    total = many.agg(F.sum(F.col("grams") * F.col("blocks")).alias("n")).first()["n"] or 0
    tasks = max(1, -(-total // (4 * grams)))
    posted = all_.join(many, "component").withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posted = posted.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).withColumn("g", F.pmod(F.xxhash64("component", "p", "q"), F.lit(tasks)))
    counted = posted.select("g", "component", "p", "q", "own", "key", "n", "copies", "parts").groupBy("g").applyInArrow(_block_links, "key long, links long")
    two = all_.join(size.where("k = 2"), "component").select("key", (F.col("all") - F.col("copies")).alias("links"))
    return counted.groupBy("key").agg(F.sum("links").alias("links")).unionByName(two)


def link_groups(docs: DataFrame, n: int = N, count_links: bool = True, fragments: int | None = None, rows: int = ROWS, grams: int = GRAMS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id) for every row, and with count_links n_links.

    n_links: the other rows with an id that the row links with, equal sets included; null for a null id.
    """
    fragments = fragments or fragment_count(docs)
    sized = written(document_sizes(docs, n, fragments), "sizes")
    classes = sized.where("n > 0").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.max("alive").alias("alive"), F.count("doc_id").alias("copies"))
    classes = written(classes.where("rep is not null").withColumn("key", F.monotonically_increasing_id()), "classes")
    chosen = classes.where("alive").select(F.col("rep").alias("doc_id"), "fp1", "fp2", "key")
    found = global_order(docs.select("doc_id", "text").join(chosen, "doc_id"), fragments, n)
    order = written(found.dropDuplicates(["key"]), "order")
    parts = order.select("key", F.explode("parts").alias("p")).select("key", "p.part", "p.grams")
    listed = order.select("key", "n", F.explode("prefix").alias("p")).select("p.gram", F.struct("p.pos", "n", "key").alias("m"))
    lead = listed.groupBy("gram").agg(F.min("m").alias("l"), F.count("*").alias("c")).where("c > 1").drop("c")
    led = listed.join(lead, "gram").where("m.key <> l.key and " + _room("m", "l")).groupBy("m.key", "m.n", F.col("l.key").alias("to"), F.col("l.n").alias("to_n"))
    best = F.max(F.struct("count", F.col("to").alias("b"), F.col("to_n").alias("nb"))).alias("x")
    first = led.count().groupBy(F.col("key").alias("a"), F.col("n").alias("na")).agg(best).select("a", "x.b", "na", "x.nb")
    links = written(overlaps(hopeful(first, order), parts), "links")
    group = written(components(links), "groups")
    member = listed.join(group.select(F.col("node").alias("k"), "component"), F.col("m.key") == F.col("k"), "left")
    member = member.select("gram", "m", F.coalesce("component", "m.key").alias("g"))
    mixed = member.groupBy("gram").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("gram")
    member = member.join(mixed, "gram")
    x, y = member.alias("x"), member.select("gram", F.col("m").alias("o"), F.col("g").alias("h")).alias("y")
    apart = x.join(y, "gram").where("g <> h and (m.n < o.n or m.n = o.n and m.key < o.key) and 5 * m.n >= 4 * o.n and " + _room("m", "o"))
    rest = apart.select(F.col("m.key").alias("a"), F.col("o.key").alias("b"), F.col("m.n").alias("na"), F.col("o.n").alias("nb")).distinct()
    more = links.unionByName(overlaps(hopeful(rest, order), parts))
    final = written(components(more), "groups")
    named = classes.join(final.withColumnRenamed("node", "key"), "key", "left").withColumn("of", F.coalesce("component", "key"))
    smallest = named.where("component is not null").groupBy("of").agg(F.min("rep").alias("low"))
    named = named.join(smallest, "of", "left").select("key", "n", "fp1", "fp2", "copies", F.coalesce("low", "rep").alias("low"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id")]
    if count_links:
        named = named.join(link_counts(order, final, classes.select("key", "copies"), rows, grams), "key", "left").withColumn("links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
        columns.append(F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    drop_written(links)
    drop_written(group)
    return sized.join(named, ["n", "fp1", "fp2"], "left").select(*columns)
