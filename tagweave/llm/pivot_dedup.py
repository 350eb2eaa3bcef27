"""Near-duplicate vectors by a pivot-permutation index.

Equal vectors are one class from the start, with the number of its ids. Each class is described by its NEAREST pivots
in order of nearness. Inverted lists stand under sets of SHARED pivots, at least one of them among the LEAD first of
the order: two classes meet in a list exactly if their shared-pivot count reaches SHARED on pivots of which each has
one in front. First only ids and permutations are listed; vectors travel to lists of two and more.

Within a list all pairs are compared in double precision, in blocks of at most BLOCK rows against BLOCK rows; a pair
that meets in several lists counts in the least of them. A block gives back, for each of its classes, a number of links
and the smallest id it hangs together with: pairs themselves are never listed, so a group of thousands costs its
comparison, not its rows.

Pivots are fitted on a bounded sample (SAMPLE vectors by hash of the id), spread as far apart as it allows; their
number grows with the cube root of the classes, so that lists of SHARED = 3 pivots stay as long as they are. All
vectors are indexed.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components link
with nothing; rows with a null id likewise, with a null component, not kept; rows that repeat an id are one vector, the
least of the valid ones component by component, and each of them has its result; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm._graph import components
from tagweave.llm._store import drop_written, written
from tagweave.llm._vectors import matrix, norms, one_each, sample, usual_length

PIVOTS_A_ROOT, MOST_PIVOTS = 7, 8192
NEAREST, SHARED, LEAD = 6, 3, 2
SAMPLE, BLOCK, GROUP, SMALL = 4096, 2048, 20_000, 48
LEAST = 0.9


def spread_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """n unit vectors of the sample, each the one least like those before it."""
    x = x / norms(x)[:, None]
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Numbers of each vector's k nearest pivots, nearest first."""
    like = (x / norms(x)[:, None]) @ pivots.T
    top = np.argpartition(-like, min(k, like.shape[1]) - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.take_along_axis(-like, top, 1).argsort(1, kind="stable"), 1)


def list_keys(code: np.ndarray, shared: int, lead: int) -> np.ndarray:
    """Keys of all sets of `shared` of each row's pivots with one of the first `lead`, in rising order."""
    picks = [p for p in combinations(range(code.shape[1]), shared) if p[0] < lead]
    if not shared or not picks:
        return np.zeros((len(code), 0), np.int64)
    made = []
    for pick in picks:
        own = np.sort(code[:, pick], axis=1).astype(np.int64)
        made.append(sum(own[:, i] << (16 * (shared - 1 - i)) for i in range(shared)))
    return np.sort(np.stack(made, axis=1), axis=1)


def _met_before(keys: np.ndarray, here: int) -> np.ndarray:
    """Which pairs of rows have a list in common that comes before `here`."""
    row, column = np.nonzero(keys < here)
    names, back, times = np.unique(keys[row, column], return_inverse=True, return_counts=True)
    some = np.flatnonzero(times > 1)
    place = np.full(len(names), -1)
    place[some] = np.arange(len(some))
    to = place[back]
    row, to = row[to >= 0], to[to >= 0]
    out = np.zeros((len(keys), len(keys)), bool)
    for low in range(0, len(some), 1024):
        own = (to >= low) & (to < low + 1024)
        x = np.zeros((len(keys), min(1024, len(some) - low)), np.float32)
        x[row[own], to[own] - low] = 1
        out |= x @ x.T > 0
    return out


def _together(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches through a symmetric link matrix."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(1))
        if (new == low).all():
            return low
        low = new


def near_duplicates(
    vectors: DataFrame, least: float = LEAST, pivots: int | None = None, nearest: int = NEAREST, shared: int = SHARED, lead: int = LEAD, block: int = BLOCK, small: int = SMALL
) -> DataFrame:
    """vectors (vec_id, embedding) -> (vec_id, n_links, component_id, kept) for every row."""
    rows = vectors.select("vec_id", "embedding")
    d = usual_length(rows)
    one = written(one_each(rows, d), "vectors")
    classes = one.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    _, some = sample(classes.withColumnRenamed("rep", "vec_id"), d, SAMPLE)
    wanted = pivots or min(MOST_PIVOTS, int(np.ceil(PIVOTS_A_ROOT * classes.count() ** (1 / 3))))
    base = spread_pivots(some, wanted) if len(some) else np.zeros((0, d))
    k = min(nearest, len(base))
    m = min(shared, k)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                which, x = matrix(batch.column("embedding"), d)
                if not len(x) or not m:
                    continue
                code = nearest_pivots(x, base, k).astype(np.int16)
                keys = list_keys(code, m, lead)
                many = pa.array(np.repeat(np.arange(len(x)), keys.shape[1]))
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.record_batch({"list": pa.array(keys.ravel()), "rep": batch.column("rep").take(pa.array(which)).take(many), "code": codes.take(many)})

    posted = classes.select("rep", "embedding").mapInArrow(describe, "list long, rep long, code binary")
    size = written(posted.groupBy("list").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    total = size.agg(F.sum("n").alias("n")).first()["n"] or 0
    groups = max(1, -(-total // GROUP))
    posted = posted.join(size, "list").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    posted = posted.withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int")).join(classes, "rep")
    posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    posted = posted.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    posted = posted.withColumn("g", F.pmod(F.xxhash64("list", "p", "q"), F.lit(groups)))

    def compare(table: pa.Table) -> pa.Table:
        key, p, q, own, ids, copies = (table.column(c).to_numpy() for c in ("list", "p", "q", "own", "rep", "copies"))
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int16).reshape(len(key), k)
        flat = table.column("embedding").combine_chunks()
        flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
        raw = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(key), d)
        order = np.lexsort((ids, q, p, key))
        edge = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1) | np.diff(p[order], prepend=-1) | np.diff(q[order], prepend=-1))
        out_id, out_n, out_low = [], [], []
        small_a, small_b = [], []

        def unit(at: np.ndarray) -> np.ndarray:
            x = raw[at].astype(np.float64)
            return x / norms(x)[:, None]

        for a, b in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist(), strict=True):
            at = order[a:b]
            if len(at) <= small:
                i, j = np.triu_indices(len(at), 1)
                small_a.append(at[i])
                small_b.append(at[j])
                continue
            x = unit(at)
            linked = x @ x.T >= least
            np.fill_diagonal(linked, False)
            if p[at[0]] != q[at[0]]:
                linked &= own[at][:, None] != own[at][None, :]
            if linked.any():
                linked &= ~_met_before(list_keys(code[at], m, lead), key[at[0]])
            got = np.flatnonzero(linked.any(1))
            out_id.append(ids[at[got]])
            out_n.append(linked[got].astype(np.float64) @ copies[at])
            out_low.append(_together(linked, ids[at])[got])
        if small_a:
            one, two = np.concatenate(small_a), np.concatenate(small_b)
            ok = (p[one] == q[one]) | (own[one] != own[two])
            one, two = one[ok], two[ok]
            for s in range(0, len(one), 1 << 15):
                i, j = one[s : s + (1 << 15)], two[s : s + (1 << 15)]
                some, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                x = unit(some)
                hit = np.flatnonzero(np.einsum("ij,ij->i", x[back[: len(i)]], x[back[len(i) :]]) >= least)
                i, j = i[hit], j[hit]
                left, right = list_keys(code[i], m, lead), list_keys(code[j], m, lead)
                common = (left[:, :, None] == right[:, None, :]).any(2)
                good = left[np.arange(len(i)), common.argmax(1)] == key[i]
                i, j = i[good], j[good]
                out_id += [ids[i], ids[j]]
                out_n += [copies[j], copies[i]]
                out_low += [np.minimum(ids[i], ids[j])] * 2
        if not out_id:
            return pa.table({"rep": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "low": pa.array([], pa.int64())})
        return pa.table({"rep": np.concatenate(out_id), "n": np.concatenate(out_n).astype(np.int64), "low": np.concatenate(out_low)})

    met = posted.select("g", "list", "p", "q", "own", "rep", "copies", "code", "embedding").groupBy("g").applyInArrow(compare, "rep long, n long, low long")
    met = written(met, "links")
    drop_written(size)
    counts = met.groupBy("rep").agg(F.sum("n").alias("links"))
    joined = components(met.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    named = classes.join(counts, "rep", "left").join(joined, "rep", "left")
    named = named.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    each = one.join(named, "embedding").select("vec_id", "links", "component")
    of = F.coalesce("component", "vec_id")
    out = rows.select("vec_id").join(each, "vec_id", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), of.alias("component_id"), F.coalesce(of == F.col("vec_id"), F.lit(False)).alias("kept"))
