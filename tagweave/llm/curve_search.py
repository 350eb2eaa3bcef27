"""Nearest neighbours by inner product from several shifted Hilbert curves.

Vectors are scaled by the largest norm and given one more component, so that the largest inner product is the least
distance (queries get length 1 and 0 there). Each curve is a Hilbert order of a shifted random projection to a few
dimensions; its keys, with a hash to split equal ones, are cut into segments of about SEGMENT rows at quantiles of a
bounded sample. A query is compared with the rows of the segments within `reach` of its own on every curve; the
windows' results are merged and ranked by exact scores. A pair met on several curves counts on the first.

How many of the curves (two at least) are used, and their reach, is fitted: on a bounded sample of queries, compared
with all rows, they are those whose windows hold the share RECALL of the true neighbours with the least rows compared.
Where the data has no near neighbours to speak of (unrelated directions in many dimensions), the windows come out
wide and the search does as much work as a comparison in blocks. Only rows that score at least what a query's TOP-th
best of a bounded sample of rows scores are handed on; that bound can drop none of the TOP best. A query that its
windows leave short of TOP rows is compared with all rows of the first curve.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows with a null id; rows that repeat an id are one vector, the least of the valid ones component by
component; ties go to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.llm._bytes import mix
from tagweave.llm._store import written
from tagweave.llm._vectors import matrix, norms, one_each, sample, usual_length

TOP, EVERY = 20, 20
CURVES, DIMENSIONS, BITS = 6, 8, 6
SEGMENT, KEYS, ROWS, TRIALS, RECALL = 1024, 65_536, 16_384, 256, 0.97
LEAST_CURVES = 2
SEED = 5


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (rows), by Gray-code transposition of their bit planes."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


class Curves:
    """Projections, shifts and cell edges of all curves, fitted on a sample."""

    def __init__(self, x: np.ndarray, longest: float, rows: int, curves: int = CURVES, segment: int = SEGMENT, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.longest = longest
        d = x.shape[1] + 1
        self.dims = min(DIMENSIONS, d)
        self.axes = [np.linalg.qr(rng.normal(size=(d, self.dims)))[0] for _ in range(curves)]
        raised = self.raised(x, False)
        self.low, self.high = [], []
        for a in self.axes:
            y = raised @ a
            low, high = y.min(0), y.max(0)
            room = np.maximum(high - low, 1e-9)
            self.low.append(low - rng.uniform(0.0, 0.5, self.dims) * room)  # the shift
            self.high.append(high + rng.uniform(0.0, 0.5, self.dims) * room)
        self.bounds: list[np.ndarray] = []
        segments = max(1, -(-rows // segment))
        keys = self.keys(raised, mix(np.arange(len(x), dtype=np.uint64)))
        for key in keys:
            key = np.sort(key)
            self.bounds.append(key[(np.arange(1, segments) * len(key)) // segments])

    def first(self, n: int) -> Curves:
        """The same without all but the first n curves."""
        out = copy.copy(self)
        out.axes, out.low, out.high, out.bounds = self.axes[:n], self.low[:n], self.high[:n], self.bounds[:n]
        return out

    def raised(self, x: np.ndarray, query: bool) -> np.ndarray:
        size = norms(x)
        if query:
            return np.hstack([x / size[:, None], np.zeros((len(x), 1))])
        return np.hstack([x / self.longest, np.sqrt(np.maximum(0, 1 - (size / self.longest) ** 2))[:, None]])

    def keys(self, raised: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
        """A key for each curve and row: its place on the curve, then 14 bits of hash."""
        out = []
        for a, low, high in zip(self.axes, self.low, self.high, strict=True):
            cell = np.clip((raised @ a - low) / (high - low) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            out.append((hilbert(cell, BITS) << 14) | (salt >> np.uint64(50)).astype(np.int64))
        return out

    def segments(self, x: np.ndarray, ids: np.ndarray, query: bool) -> np.ndarray:
        """Segment numbers, a row for each vector and a column for each curve."""
        keys = self.keys(self.raised(x, query), mix(ids.astype(np.uint64)))
        return np.stack([np.searchsorted(b, k, "right") for b, k in zip(self.bounds, keys, strict=True)], axis=1).astype(np.int32)


def _parts(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            which, x = matrix(batch.column("embedding"), d)
            ids = batch.column("vec_id").take(pa.array(which))
            known = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                yield ids.take(pa.array(known)).to_numpy(), x[known]


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> list[np.ndarray]:
    """Columns of each row's `top` largest scores, ties by id."""
    out = []
    for row in scores:
        some = np.arange(len(row))
        if len(row) > top:
            some = np.flatnonzero(row >= np.partition(row, len(row) - top)[len(row) - top])
        some = some[row[some] > -np.inf]
        out.append(some[np.lexsort((ids[some], -row[some]))][:top])
    return out


def search(
    vectors: DataFrame, top: int = TOP, every: int = EVERY, curves: int = CURVES, recall: float = RECALL, segment: int = SEGMENT, fit: tuple[int, int] | None = None
) -> DataFrame:
    """vectors (vec_id, embedding) -> (query_id, rank, vec_id, score): for each row whose id `every` divides, its `top` best others.

    fit gives the number of curves and the reach, instead of fitting them.
    """
    spark = vectors.sparkSession
    d = usual_length(vectors.select("vec_id", "embedding"))
    rows = written(one_each(vectors.select("vec_id", "embedding"), d), "vectors")
    _, some = sample(rows, d, ROWS)
    if not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, longest = 0, 0.0
        for _, x in _parts(batches, d):
            n, longest = n + len(x), max(longest, float(norms(x).max()))
        yield pa.record_batch({"n": [n], "longest": [longest]})

    total = rows.mapInArrow(measure, "n long, longest double").agg(F.sum("n").alias("n"), F.max("longest").alias("longest")).first()
    model = Curves(sample(rows, d, KEYS)[1], total["longest"], total["n"], curves, segment)
    widest = len(model.bounds[0])
    used, reach = fit or (fitted(rows, model, d, top, every, recall) if widest else (1, 0))
    floor = spark.sparkContext.broadcast(some)  # ROWS vectors at most
    asked = F.col("vec_id") % every == 0
    met = _windows(rows, rows.where(asked), model.first(used), d, top, reach, floor)
    met = written(met, "met")
    enough = met.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")).where(F.col("n") >= min(top, total["n"] - 1))
    short = written(rows.where(asked).join(enough, "vec_id", "left_anti"), "short")
    if short.count():
        again = _windows(rows, short, model.first(1), d, top, widest, None)
        met = met.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _windows(rows: DataFrame, queries: DataFrame, model: Curves, d: int, top: int, reach: int, floor: Broadcast | None) -> DataFrame:
    """(query_id, vec_id, score): each query's `top` best of every segment within reach of its own, each pair once."""
    curves, widest = len(model.axes), len(model.bounds[0])

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _parts(batches, d):
            own = model.segments(x, ids, False)
            many = np.repeat(np.arange(len(ids)), curves)
            yield _placed(ids[many], np.tile(np.arange(curves), len(ids)), own.ravel(), False, np.full(len(many), -np.inf), own[many], x[many])

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _parts(batches, d):
            own, need = model.segments(x, ids, True), np.full(len(ids), -np.inf)
            if floor is not None:
                like = x @ floor.value.T
                like = like - 1e-9 * (1 + np.abs(like))
                if like.shape[1] > top:
                    need = np.partition(like, -top - 1, axis=1)[:, -top - 1]
            for step in range(-reach, reach + 1):
                to = own + step
                r, c = np.nonzero((to >= 0) & (to <= widest))
                if len(r):
                    yield _placed(ids[r], c, to[r, c], True, need[r], own[r], x[r])

    def compare(table: pa.Table) -> pa.Table:
        is_query = table.column("query").to_numpy(zero_copy_only=False)
        ids, curve, need = (table.column(c).to_numpy() for c in ("vec_id", "curve", "need"))
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float64).reshape(len(ids), d)
        segment = np.frombuffer(b"".join(table.column("segments").to_pylist()), np.int32).reshape(len(ids), curves)
        ask, have = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        have = have[np.argsort(ids[have], kind="stable")]
        out_q, out_v = [], []
        c = int(curve[0])
        for s in range(0, len(ask) if len(have) else 0, 128):
            q = ask[s : s + 128]
            scores = x[q] @ x[have].T
            scores[(ids[q][:, None] == ids[have][None, :]) | (scores < need[q][:, None])] = -np.inf
            for earlier in range(c):
                scores[np.abs(segment[q, earlier][:, None] - segment[have, earlier][None, :]) <= reach] = -np.inf
            for i, cols in zip(q.tolist(), best(scores, ids[have], top), strict=True):
                out_q.append(np.full(len(cols), i))
                out_v.append(have[cols])
        q = np.concatenate(out_q) if out_q else np.zeros(0, np.int64)
        v = np.concatenate(out_v) if out_v else np.zeros(0, np.int64)
        return pa.table({"query_id": ids[q], "vec_id": ids[v], "score": (x[q] * x[v]).sum(1)})

    kind = "vec_id long, curve int, segment int, query boolean, need double, segments binary, x binary"
    placed = rows.mapInArrow(place_rows, kind).unionByName(queries.mapInArrow(place_queries, kind))
    return placed.groupBy("curve", "segment").applyInArrow(compare, "query_id long, vec_id long, score double")


def _placed(ids: np.ndarray, curve: np.ndarray, segment: np.ndarray, query: bool, need: np.ndarray, segments: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({
        "vec_id": pa.array(ids, pa.int64()), "curve": pa.array(curve.astype(np.int32)), "segment": pa.array(segment.astype(np.int32)), "query": pa.array(np.full(len(ids), query)),
        "need": pa.array(need), "segments": pa.array([s.tobytes() for s in segments], pa.binary()), "x": pa.array([v.tobytes() for v in x], pa.binary()),
    })


def fitted(rows: DataFrame, model: Curves, d: int, top: int, every: int, recall: float) -> tuple[int, int]:
    """(curves, reach): those with the least segments compared whose windows hold the share `recall` of the neighbours
    that a bounded sample of queries, each compared with all rows, has."""
    trial = rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS).toArrow()
    which, q = matrix(trial.column("embedding"), d)
    names = trial.column("vec_id").to_numpy()[which]
    if not len(q):
        return 1, 0

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, who, where = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0, len(model.axes)), np.int32)
        for ids, x in _parts(batches, d):
            new = q @ x.T
            new[names[:, None] == ids[None, :]] = -np.inf
            keep = np.argpartition(-new, min(top, new.shape[1]) - 1, axis=1)[:, :top]
            own = model.segments(x, ids, False)
            score, who = np.concatenate([score, np.take_along_axis(new, keep, 1)], axis=1), np.concatenate([who, ids[keep]], axis=1)
            where = np.concatenate([where, own[keep]], axis=1)
            cut = np.argsort(-score, axis=1, kind="stable")[:, :top]
            score, who, where = np.take_along_axis(score, cut, 1), np.take_along_axis(who, cut, 1), np.take_along_axis(where, cut[:, :, None], 1)
        i, j = np.nonzero(score > -np.inf)
        yield pa.record_batch({"q": pa.array(i.astype(np.int32)), "vec_id": who[i, j], "score": score[i, j], "segments": pa.array([s.tobytes() for s in where[i, j]], pa.binary())})

    rank = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = rows.mapInArrow(nearest, "q int, vec_id long, score double, segments binary").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= top)
    got = found.select("q", "segments").toArrow()
    own = model.segments(q, names, True)[got.column("q").to_numpy()]
    other = np.frombuffer(b"".join(got.column("segments").to_pylist()), np.int32).reshape(-1, len(model.axes))
    apart = np.minimum.accumulate(np.abs(own - other), axis=1)
    if not len(apart):
        return 1, 0
    all_ = len(model.bounds[0]) + 1
    options = []
    for n in range(min(LEAST_CURVES, len(model.axes)), len(model.axes) + 1):
        reach = int(np.quantile(apart[:, n - 1], recall, method="higher"))
        options.append((n * min(all_, 2 * reach + 1), n, reach))
    _, n, reach = min(options)
    return n, reach
