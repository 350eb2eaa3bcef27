"""The evaluation harness: predictions beside truths, metrics per post, means, grids."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import metrics as M
from tagweave.functions.arrays import angular_of, matrix, numbered
from tagweave.plans.recommend import SCORE_DIGITS

#: Queries times tags that are ranked at a time.
CELLS = 1 << 19


def grid(spark: SparkSession, lists: dict[str, list]) -> DataFrame:
    """The product of hyper-parameter lists."""
    out = spark.range(0, 1, 1, 1)
    for name, values in lists.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) if not isinstance(v, int) else F.lit(v).cast("long") for v in values])))
    return out.drop("id")


def recommended(rankings: DataFrame, truths: DataFrame) -> DataFrame:
    """rankings (query, rank, hashtag), truths (query, truth) -> (query, truth, predicted); no ranking is an empty one."""
    lists = rankings.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "hashtag"))).alias("r"))
    none = F.array().cast("array<string>")
    return truths.join(lists, "query", "left").select("query", "truth", F.coalesce(F.transform("r", lambda x: x["hashtag"]), none).alias("predicted"))


def measured(rows: DataFrame, k: int) -> DataFrame:
    """rows (truth, predicted) with recall, precision, f1, ap and ndcg at k."""
    t, p = F.col("truth"), F.col("predicted")
    return rows.withColumns({"recall": M.recall(t, p, k), "precision": M.precision(t, p, k), "f1": M.f1(t, p, k), "ap": M.average_precision(t, p, k), "ndcg": M.ndcg(t, p, k)})


def evaluate(test: DataFrame, recommend: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """The rows of test (query, truth, ...) with predicted, and the metrics at k of what `recommend` makes of them.

    recommend: a function from test's rows to (query, rank, hashtag), such as a fitted recommender's transform.
    """
    lists = recommended(recommend(test.drop("truth")), test.select("query", "truth"))
    return measured(test.drop("truth").join(lists, "query"), k)


def means(rows: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def grid_search(test: DataFrame, profile: DataFrame, popularities: list[str], limits: list[int], ratios: list[float], ks: list[int], total: DataFrame) -> DataFrame:
    """(dataset, popularity, least, ratio, k, recall, precision, n) of every combination, from one profile.

    test (query, truth, embedding, retweet_count); profile (hashtag, embedding, count, and a column for each of
    popularities). A limit of l leaves the tags with at least one l-th of `total` occurrences. Similarities are made
    once; normalisation goes within a query, a popularity and a limit. The profile is sent to every executor; a query is
    ranked in its own row, all combinations of it, and only sums are shuffled.
    """
    tags = profile.select("hashtag", "embedding", "count", *[F.col(p).cast("double") for p in popularities]).orderBy("hashtag").toArrow()
    count, n, most = tags.column("count").to_numpy(), int(total.first()[0]), max(ks)
    pops = {p: tags.column(p).to_numpy() for p in popularities}
    sent = test.sparkSession.sparkContext.broadcast((tags.column("hashtag").combine_chunks(), matrix(tags.column("embedding").combine_chunks())))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ends = sent.value
        far = np.sqrt(np.einsum("ij,ij->i", ends, ends))
        found: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(3))
        for batch in batches:
            for at in range(0, batch.num_rows, high := max(1, CELLS // max(1, len(names)))):
                part = batch.slice(at, high)
                x = matrix(part.column("embedding"), ends.shape[1])
                sims = angular_of(x @ ends.T, np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], far)
                relevant = np.zeros(sims.shape)
                relevant[numbered(part.column("truth"), names)] = 1.0
                size = part.column("truth").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                popular = part.column("popular").to_numpy(zero_copy_only=False)
                for least in limits:
                    some = np.flatnonzero(count >= n // least)
                    if not len(some):
                        continue
                    s = _scaled(sims[:, some])
                    for p in popularities:
                        other = _scaled(pops[p][None, some])
                        for ratio in ratios:
                            score = np.round((1 - ratio) * s + ratio * other, SCORE_DIGITS)
                            top = np.argsort(-score, axis=1, kind="stable")[:, :most]
                            hits = np.cumsum(np.take_along_axis(relevant, some[top], 1), 1)
                            for k in ks:
                                right = hits[:, min(k, len(some)) - 1]
                                recall = np.where(size == 0, 1.0, right / np.maximum(size, 1))
                                precision = np.where(size == 0, 1.0, right / min(k, len(some)))
                                for dataset, of in (("popular", popular), ("unpopular", ~popular)):
                                    if of.any():
                                        found[dataset, p, least, ratio, k] += [recall[of].sum(), precision[of].sum(), of.sum()]
        yield pa.RecordBatch.from_pylist([dict(zip(key, (*of, *x), strict=True)) for of, x in found.items()], pa.schema(list(zip(key, kinds, strict=True))))

    key = ["dataset", "popularity", "least", "ratio", "k", "r", "p", "n"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    rows = test.select("truth", "embedding", F.coalesce(F.col("retweet_count") > 0, F.lit(False)).alias("popular"))
    made = rows.mapInArrow(sums, "dataset string, popularity string, least long, ratio double, k long, r double, p double, n double")
    mean = lambda c, name: F.round(F.sum(c) / F.sum("n"), 6).alias(name)
    return made.groupBy(*key[:5]).agg(mean("r", "recall"), mean("p", "precision"), F.sum("n").cast("long").alias("n"))


def _scaled(x: np.ndarray) -> np.ndarray:
    low, high = x.min(1, keepdims=True), x.max(1, keepdims=True)
    return (x - low) / (high - low + 1e-18)
