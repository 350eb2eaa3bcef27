"""Registered queries: scores, rankings, metrics, grids and the popularity recommender."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import metrics as M
from tagweave.plans import evaluate as E
from tagweave.plans import recommend as R
from tagweave.plans import views as V
from tagweave.plans.models import _ANG, _RANK, _TAGE
from tagweave.plans.registry import register as q
from tagweave.plans.views import sql
from tagweave.sources.store import saved

#: The queries are the vectors whose id 20 divides; all posts are fitted.
_COSQ = "list_inner_product(q.v, e) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e, e)))"
_SIM = _TAGE.rstrip() + f", sm AS (SELECT q.vec_id AS query, hashtag, {_ANG.format(_COSQ)} AS sim, mean_retweets AS pop FROM emb q CROSS JOIN prof WHERE q.vec_id % 20 = 0) "
_NORM = _SIM.rstrip() + ", nm AS (SELECT query, hashtag, (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w + 1e-18) AS s, (pop - min(pop) OVER w) / (max(pop) OVER w - min(pop) OVER w + 1e-18) AS p FROM sm WINDOW w AS (PARTITION BY query)) "
_MIX = _NORM.rstrip() + ", mx AS (SELECT query, hashtag, round(0.6e0 * s + 0.4e0 * p, 9) AS score FROM nm), rk AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, hashtag) AS rank, hashtag, score FROM mx) "


def _model(s, d, **more):
    return R.Popularity(least=V.size(V.table(s, d, "events")).select(F.expr("_n div 100")), **more).fit(V.events(s, d, embedding=True))


def _asked(s, d):
    return V.table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("embedding"))


def _ranked(df, digits=6):
    return df.select("query", F.col("rank").cast("long").alias("rank"), "hashtag", F.round("score", digits).alias("score"))


@q("recommend_mean_retweets", sql("eve", _MIX + "SELECT query, rank, hashtag, round(score, 6) AS score FROM rk WHERE rank <= 10"))
def _(s, d):
    return _ranked(_model(s, d).from_embeddings(_asked(s, d), 10))


@q("cross_similarity", sql("eve", _SIM + "SELECT query, hashtag, round(sim, 6) AS sim FROM sm"))
def _(s, d):
    from tagweave.functions.vectors import angular_similarity

    p = _model(s, d).profile.select("hashtag", F.col("embedding").alias("e"))
    return _asked(s, d).crossJoin(p).select("query", "hashtag", F.round(angular_similarity(F.col("embedding"), F.col("e")), 6).alias("sim"))


@q("minmax_normalise", sql("eve", _NORM + "SELECT query, hashtag, round(s, 6) AS s, round(p, 6) AS p FROM nm"))
def _(s, d):
    from tagweave.functions.vectors import angular_similarity

    p = _model(s, d).profile.select("hashtag", F.col("embedding").alias("e"), F.col("mean_retweets").alias("pop"))
    both = _asked(s, d).crossJoin(p).withColumn("sim", angular_similarity(F.col("embedding"), F.col("e")))
    return both.select("query", "hashtag", F.round(R.minmax("sim"), 6).alias("s"), F.round(R.minmax("pop"), 6).alias("p"))


@q("score_mix", sql("eve", _MIX + "SELECT query, hashtag, round(score, 6) AS score FROM rk"))
def _(s, d):
    return _ranked(_model(s, d).from_embeddings(_asked(s, d))).drop("rank")


@q("score_mix_additive", sql("eve", _NORM + ", mx AS (SELECT query, hashtag, round(s + 0.4e0 * p, 9) AS score FROM nm) SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, hashtag) AS rank, hashtag, round(score, 6) AS score FROM mx"))
def _(s, d):
    return _ranked(_model(s, d, additive=True).from_embeddings(_asked(s, d)))


@q("rank_hashtags", sql("eve", _MIX + "SELECT query, rank, hashtag FROM rk"))
def _(s, d):
    return _ranked(_model(s, d).from_embeddings(_asked(s, d))).drop("score")


@q("topk_hashtags", sql("eve", _MIX + "SELECT query, rank, hashtag FROM rk WHERE rank <= 5"))
def _(s, d):
    return _ranked(_model(s, d).from_embeddings(_asked(s, d), 5)).drop("score")


_PR = _RANK.rstrip() + f", pr AS (SELECT substr(node, 2) AS hashtag, x FROM x3 WHERE node LIKE 't%'), sm AS (SELECT q.vec_id AS query, hashtag, {_ANG.format(_COSQ)} AS sim, x AS pop FROM emb q CROSS JOIN prof JOIN pr USING (hashtag) WHERE q.vec_id % 20 = 0)" + _MIX[_MIX.index(", nm AS"):]


@q("recommend_pagerank_iter_k", sql("eve", _PR + "SELECT query, rank, hashtag, round(score, 6) AS score FROM rk WHERE rank <= 10"))
def _(s, d):
    return _ranked(_model(s, d, popularity="pagerank", steps=3).from_embeddings(_asked(s, d), 10))


@q("recommend_pagerank")
def _(s, d):
    return _ranked(_model(s, d, popularity="pagerank").from_embeddings(_asked(s, d), 10))


# Evaluation of the popularity recommender: the queries are the posts whose id 20 divides, their truth their tags.
_TEST = _TAGE.rstrip() + f""", sm AS (SELECT q.id AS query, hashtag, {_ANG.format(_COSQ.replace("q.v", "q.embedding"))} AS sim, mean_retweets AS pop FROM eve q CROSS JOIN prof WHERE q.id % 20 = 0)""" + _MIX[_MIX.index(", nm AS"):].rstrip()
_PRED = _TEST + """, pd AS (SELECT query, list(hashtag ORDER BY rank) AS pred FROM rk WHERE rank <= 10 GROUP BY query), ev2 AS (SELECT id, retweet_count, hashtags AS truth, pred FROM eve JOIN pd ON id = query),
 mt AS (SELECT id, retweet_count, truth, pred, {k} AS k, len(list_intersect(truth, pred[1:{k}])) AS hits FROM ev2),
 m AS (SELECT id, retweet_count, truth, pred, k, hits / len(truth) AS recall, hits / least(len(pred), k) AS precision,
 list_sum(list_transform(range(1, 1 + least(len(pred), k)), lambda i: CASE WHEN list_contains(truth, pred[i]) THEN len(list_filter(pred[1:i], lambda y: list_contains(truth, y))) / i ELSE 0 END)) / least(len(truth), k) AS ap,
 list_sum(list_transform(range(1, 1 + least(len(pred), k)), lambda i: CASE WHEN list_contains(truth, pred[i]) THEN 1 / log2(i + 1) ELSE 0 END)) / list_sum(list_transform(range(1, 1 + least(len(truth), k)), lambda i: 1 / log2(i + 1))) AS ndcg FROM mt),
 mf AS (SELECT *, CASE WHEN recall + precision = 0 THEN 0 ELSE 2 * recall * precision / (recall + precision) END AS f1 FROM m) """


def _pred(k: int = 5) -> str:
    return _PRED.replace("{k}", str(k))


def _test(s, d):
    posts = V.common_events(s, d, embedding=True).where("id % 20 = 0")
    return posts.select(F.col("id").alias("query"), F.col("hashtags").alias("truth"), "embedding", "retweet_count")


def _evaluated(s, d, k: int = 5):
    model = _model(s, d)
    return E.evaluate(_test(s, d), lambda asked: model.from_embeddings(asked, 10), k)


def _metric(name: str, column: str) -> None:
    @q(name, sql("eve", _pred() + f"SELECT id, round({column}, 6) AS value FROM mf"))
    def _(s, d):
        return _evaluated(s, d).select(F.col("query").alias("id"), F.round(column, 6).alias("value"))


_metric("recall_at_k", "recall")
_metric("precision_at_k", "precision")
_metric("f1_at_k", "f1")


@q("hits_at_k", sql("eve", _pred() + "SELECT id, CAST(hits AS BIGINT) AS hits FROM mt"))
def _(s, d):
    return _evaluated(s, d).select(F.col("query").alias("id"), M.hits(F.col("truth"), F.col("predicted"), 5).cast("long").alias("hits"))


def _means(name: str, columns: list[str]) -> None:
    @q(name, sql("eve", _pred() + "SELECT count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in columns) + " FROM mf"))
    def _(s, d):
        return E.means(_evaluated(s, d), columns)


_means("mean_metrics_at_k", ["recall", "precision", "f1"])
_means("map_at_k", ["ap"])
_means("ndcg_at_k", ["ndcg"])
_means("evaluate", ["recall", "ap", "ndcg"])
_means("eval_means", ["recall", "ap", "ndcg", "f1"])


@q("eval_by_dataset", sql("eve", _pred() + "SELECT CASE WHEN retweet_count > 0 THEN 'popular' ELSE 'unpopular' END AS dataset, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(ap), 6) AS ap, round(avg(ndcg), 6) AS ndcg FROM mf GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(recall), 6), round(avg(ap), 6), round(avg(ndcg), 6) FROM mf"))
def _(s, d):
    part = F.explode(F.array(F.lit("all"), F.when(F.col("retweet_count") > 0, "popular").otherwise("unpopular")))
    return E.means(_evaluated(s, d).withColumn("dataset", part), ["recall", "ap", "ndcg"], ["dataset"])


@q("hyperparameter_grid", "SELECT e AS embedding, p AS popularity, r AS ratio, k FROM (SELECT unnest(['mean', 'sif']) AS e), (SELECT unnest(['mean_retweets', 'pagerank']) AS p), (SELECT unnest([0, 0.2e0, 0.4e0, 0.6e0, 0.8e0, 1]) AS r), (SELECT unnest([5, 15, 100]::BIGINT[]) AS k)")
def _(s, d):
    return E.grid(s, {"embedding": ["mean", "sif"], "popularity": ["mean_retweets", "pagerank"], "ratio": [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], "k": [5, 15, 100]})


_GRID = _RANK.rstrip() + f""", pr AS (SELECT substr(node, 2) AS hashtag, x FROM x3 WHERE node LIKE 't%'), oc AS (SELECT hashtag, count(*) AS occ FROM evk GROUP BY 1), pf AS (SELECT prof.hashtag, e, mean_retweets, x, occ FROM prof JOIN pr USING (hashtag) JOIN oc USING (hashtag)),
 sims AS (SELECT q.id AS query, hashtag, {_ANG.format(_COSQ.replace("q.v", "q.embedding"))} AS sim, mean_retweets, x, occ FROM eve q CROSS JOIN pf WHERE q.id % 20 = 0),
 gp AS (SELECT * FROM (SELECT unnest(['mean_retweets', 'pagerank']) AS popularity), (SELECT unnest([100, 20]::BIGINT[]) AS least)),
 sm AS (SELECT popularity, least, query, hashtag, sim, CASE WHEN popularity = 'pagerank' THEN x ELSE mean_retweets END AS pop FROM sims, gp WHERE occ >= (SELECT count(*) FROM events) // least),
 nm AS (SELECT popularity, least, query, hashtag, (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w + 1e-18) AS s, (pop - min(pop) OVER w) / (max(pop) OVER w - min(pop) OVER w + 1e-18) AS p FROM sm WINDOW w AS (PARTITION BY popularity, least, query)),
 mx AS (SELECT popularity, least, ratio, query, hashtag, round((1 - ratio) * s + ratio * p, 9) AS score FROM nm, (SELECT unnest([0e0, 0.4e0, 1e0]) AS ratio)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY popularity, least, ratio, query ORDER BY score DESC, hashtag) AS rank FROM mx),
 pd AS (SELECT popularity, least, ratio, query, list(hashtag ORDER BY rank) AS pred FROM rk WHERE rank <= 5 GROUP BY 1, 2, 3, 4),
 g0 AS (SELECT CASE WHEN retweet_count > 0 THEN 'popular' ELSE 'unpopular' END AS dataset, popularity, least, ratio, k, len(list_intersect(hashtags, pred[1:k])) AS hits, hashtags AS truth, pred FROM pd JOIN eve ON id = query, (SELECT unnest([1, 3, 5]::BIGINT[]) AS k)),
 g AS (SELECT dataset, popularity, least, ratio, k, round(avg(hits / len(truth)), 6) AS recall, round(avg(hits / least(len(pred), k)), 6) AS precision, count(*) AS n FROM g0 GROUP BY 1, 2, 3, 4, 5) """


def _fitted(s, d):
    """(profile with pagerank and counts, test rows), both saved."""
    model = _model(s, d, popularity="pagerank", steps=3)
    counts = V.events(s, d).select(F.explode("hashtags").alias("hashtag")).groupBy("hashtag").agg(F.count("*").alias("count"))
    return saved(model.profile.join(counts, "hashtag"), "profile"), saved(_test(s, d), "test")


def _gridded(s, d, fitted=None):
    profile, test = fitted or _fitted(s, d)
    return E.grid_search(test, profile, ["mean_retweets", "pagerank"], [100, 20], [0.0, 0.4, 1.0], [1, 3, 5], V.size(V.table(s, d, "events")))


_COMBINATION = ["popularity", "least", "ratio", "k"]


@q("grid_search", sql("eve", _GRID + "SELECT dataset, popularity, least, ratio, k, recall, precision, n FROM g"))
def _(s, d):
    return _gridded(s, d)


@q("grid_filter", sql("eve", _GRID + "SELECT dataset, popularity, ratio, k, recall FROM g WHERE popularity = 'pagerank' AND least = 100 AND k = 5 AND dataset = 'popular'"))
def _(s, d):
    return _gridded(s, d).where("popularity = 'pagerank' and least = 100 and k = 5 and dataset = 'popular'").select("dataset", "popularity", "ratio", "k", "recall")


@q("argmax_rows", sql("eve", _GRID + "SELECT dataset, popularity, least, ratio, k, recall FROM g WHERE recall = (SELECT max(recall) FROM g)"))
def _(s, d):
    g = saved(_gridded(s, d), "grid")
    return g.join(F.broadcast(g.agg(F.max("recall").alias("recall"))), "recall").select("dataset", *_COMBINATION, "recall")


@q("recode_values", sql("eve", _GRID + "SELECT CASE dataset WHEN 'popular' THEN 'P' WHEN 'unpopular' THEN 'U' ELSE dataset END AS dataset, popularity, least, ratio, k FROM g"))
def _(s, d):
    return _gridded(s, d).replace({"popular": "P", "unpopular": "U"}, subset=["dataset"]).select("dataset", *_COMBINATION)


@q("metric_average", sql("eve", _GRID + "SELECT dataset, popularity, least, ratio, k, round((recall + precision) / 2, 5) AS mean FROM g"))
def _(s, d):
    return _gridded(s, d).select("dataset", *_COMBINATION, F.round((F.col("recall") + F.col("precision")) / 2, 5).alias("mean"))


@q("any_predicate", sql("eve", _GRID + "SELECT bool_or(a.recall > b.recall) AS any_better FROM g a JOIN g b ON a.popularity = b.popularity AND a.least = b.least AND a.ratio = b.ratio AND a.k = b.k AND a.dataset = 'popular' AND b.dataset = 'unpopular'"))
def _(s, d):
    g = saved(_gridded(s, d), "grid")
    a, b = g.where("dataset = 'popular'").select(*_COMBINATION, F.col("recall").alias("x")), g.where("dataset = 'unpopular'").select(*_COMBINATION, F.col("recall").alias("y"))
    return a.join(b, _COMBINATION).agg(F.bool_or(F.col("x") > F.col("y")).alias("any_better"))


@q("grid_pivot", sql("eve", _GRID + "SELECT k, ratio, round(avg(CASE WHEN dataset = 'popular' THEN recall END), 5) AS popular, round(avg(CASE WHEN dataset = 'unpopular' THEN recall END), 5) AS unpopular FROM g GROUP BY k, ratio"))
def _(s, d):
    return _gridded(s, d).groupBy("k", "ratio").pivot("dataset", ["popular", "unpopular"]).agg(F.round(F.avg("recall"), 5))


@q("method_means", sql("eve", _GRID + "SELECT popularity, ratio, round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision FROM g WHERE k >= 3 GROUP BY 1, 2"))
def _(s, d):
    return _gridded(s, d).where("k >= 3").groupBy("popularity", "ratio").agg(*[F.round(F.avg(c), 5).alias(c) for c in ("recall", "precision")])


@q("grid_quartiles", sql("eve", _GRID + "SELECT popularity, round(quantile_cont(recall, 0.25), 5) AS q1, round(quantile_cont(recall, 0.5), 5) AS q2, round(quantile_cont(recall, 0.75), 5) AS q3, round(stddev_samp(recall) / sqrt(count(*)), 5) AS error FROM g GROUP BY 1"))
def _(s, d):
    p = F.percentile("recall", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = _gridded(s, d).groupBy("popularity").agg(p.alias("p"), F.round(F.stddev_samp("recall") / F.sqrt(F.count("*")), 5).alias("error"))
    return g.select("popularity", *[F.round(F.col("p")[i], 5).alias(f"q{i + 1}") for i in range(3)], "error")


_RANDOM = """, tt AS (SELECT hashtag, row_number() OVER (ORDER BY hashtag) AS i FROM prof), dw AS (SELECT id AS query, unnest(range(1, 6)) AS rank FROM eve WHERE id % 20 = 0),
 rd AS (SELECT query, list(hashtag ORDER BY rank) AS pred FROM dw JOIN tt ON i = CAST('0x' || md5('1337|' || query || '|' || rank)[1:8] AS BIGINT) % (SELECT count(*) FROM tt) + 1 GROUP BY query),
 rr AS (SELECT k, round(avg(len(list_intersect(hashtags, pred[1:k])) / len(hashtags)), 6) AS recall FROM rd JOIN eve ON id = query, (SELECT unnest([1, 3, 5]::BIGINT[]) AS k) GROUP BY k) """


@q("union_methods", sql("eve", _GRID.rstrip() + _RANDOM + "SELECT popularity AS method, ratio, k, recall FROM g WHERE least = 100 AND dataset = 'popular' UNION ALL SELECT 'random', NULL, k, recall FROM rr"))
def _(s, d):
    tags, test = _fitted(s, d)
    g = _gridded(s, d, (tags, test)).where("least = 100 and dataset = 'popular'").select(F.col("popularity").alias("method"), "ratio", "k", "recall")
    lists = saved(E.recommended(R.random_tags(test, tags, 5, 1337), test.select("query", "truth")), "drawn")
    drawn = [E.means(E.measured(lists, k), ["recall"]).select(F.lit("random").alias("method"), F.lit(k).cast("long").alias("k"), "recall") for k in (1, 3, 5)]
    return g.unionByName(drawn[0].unionByName(drawn[1]).unionByName(drawn[2]), allowMissingColumns=True)
