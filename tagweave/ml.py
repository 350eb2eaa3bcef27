"""The recommenders as pyspark.ml estimators and models, with parameters, save and load.

An estimator's fit() takes posts; its model's transform() takes queries and gives (query, rank, hashtag, score). A
model is a few tables; save() writes them below a path as Parquet with the parameters beside them, load() reads them.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession

from tagweave.plans import recommend as R
from tagweave.sources.store import saved


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class _Ranked(Params):
    """Parameters that all recommenders share."""

    k = _param("k", "how many tags a query gets; 0 for all", TypeConverters.toInt)

    def _of(self) -> dict:
        return {p.name: self.getOrDefault(p) for p in self.params if self.hasParam(p.name) and self.isDefined(p)}

    def _limit(self) -> int | None:
        return self.getOrDefault("k") or None


class _Tables(Model, _Ranked):
    """A model that consists of named tables."""

    TABLES: tuple[str, ...] = ()

    def __init__(self, tables: dict[str, DataFrame] | None = None, values: dict | None = None):
        super().__init__()
        self.tables = tables or {}
        self._setDefault(k=0)
        for name, value in (values or {}).items():
            self._set(**{name: value})

    def save(self, path: str) -> None:
        for name in self.TABLES:
            self.tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
        spark = next(iter(self.tables.values())).sparkSession
        spark.createDataFrame([(json.dumps(self._of()),)], "value string").write.mode("overwrite").text(f"{path}/parameters")

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> _Tables:
        spark = spark or SparkSession.getActiveSession()
        values = json.loads(spark.read.text(f"{path}/parameters").first()["value"])
        return cls({name: spark.read.parquet(f"{path}/{name}") for name in cls.TABLES}, values)


class _Mixed(_Ranked):
    ratio = _param("ratio", "share of popularity in the score, from 0 to 1", TypeConverters.toFloat)
    popularity = _param("popularity", "mean_retweets or pagerank", TypeConverters.toString)
    least = _param("least", "occurrences that a tag needs", TypeConverters.toInt)


class PopularityModel(_Tables, _Mixed):
    """queries (query, embedding) -> ranked tags."""

    TABLES = ("profile",)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = R.Popularity(self.getOrDefault("ratio"), self.getOrDefault("popularity"), self.getOrDefault("least"))
        own.profile = self.tables["profile"]
        return own.from_embeddings(dataset, self._limit())


class PopularityRecommender(Estimator, _Mixed):
    """posts (id, retweet_count, hashtags, embedding) -> PopularityModel."""

    def __init__(self, ratio: float = 0.4, popularity: str = "mean_retweets", least: int = 10, k: int = 0):
        super().__init__()
        self._setDefault(ratio=0.4, popularity="mean_retweets", least=10, k=0)
        self._set(ratio=ratio, popularity=popularity, least=least, k=k)

    def _fit(self, dataset: DataFrame) -> PopularityModel:
        own = R.Popularity(self.getOrDefault("ratio"), self.getOrDefault("popularity"), self.getOrDefault("least")).fit(dataset)
        return PopularityModel({"profile": saved(own.profile, "profile")}, self._of())


class _Walked(_Ranked):
    damping = _param("damping", "share of a step that follows the graph", TypeConverters.toFloat)
    threshold = _param("threshold", "total change below which the walk ends", TypeConverters.toFloat)
    most = _param("most", "steps at most", TypeConverters.toInt)
    least = _param("least", "occurrences that a tag needs", TypeConverters.toInt)


class GraphWalkModel(_Tables, _Walked):
    """queries (query, lemmas[, tag]) -> ranked tags."""

    TABLES = ("edges", "idf", "weights", "tags")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = R.GraphWalk(*(self.getOrDefault(n) for n in ("damping", "threshold", "most", "least")))
        own.edges, own.idf, own.weights, own.tags = (self.tables[n] for n in self.TABLES)
        return own.from_lemmas(dataset, self._limit())


class GraphWalkRecommender(Estimator, _Walked):
    """posts (id, username, hashtags, lemmas) -> GraphWalkModel."""

    def __init__(self, damping: float = 0.8, threshold: float = 1e-4, most: int = 100, least: int = 3, k: int = 0):
        super().__init__()
        self._setDefault(damping=0.8, threshold=1e-4, most=100, least=3, k=0)
        self._set(damping=damping, threshold=threshold, most=most, least=least, k=k)

    def _fit(self, dataset: DataFrame) -> GraphWalkModel:
        own = R.GraphWalk(*(self.getOrDefault(n) for n in ("damping", "threshold", "most", "least"))).fit(dataset)
        return GraphWalkModel({n: getattr(own, n) for n in GraphWalkModel.TABLES}, self._of())


class _Clustered(_Ranked):
    neighbours = _param("neighbours", "nearest points that the radius is the mean distance of", TypeConverters.toInt)


class ClustersModel(_Tables, _Clustered):
    """queries (query, embedding) -> ranked tags."""

    TABLES = ("medoids", "tags")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = R.Clusters(self.getOrDefault("neighbours"))
        own.medoids, own.tags = self.tables["medoids"], self.tables["tags"]
        return own.from_embeddings(dataset, self._limit())


class ClustersRecommender(Estimator, _Clustered):
    """posts (id, hashtags, embedding) -> ClustersModel."""

    def __init__(self, neighbours: int = 16, k: int = 0):
        super().__init__()
        self._setDefault(neighbours=16, k=0)
        self._set(neighbours=neighbours, k=k)

    def _fit(self, dataset: DataFrame) -> ClustersModel:
        from tagweave.operators.hashtags import exploded

        own = R.Clusters(self.getOrDefault("neighbours")).fit(dataset.select("id", "embedding"), exploded(dataset))
        return ClustersModel({"medoids": saved(own.medoids, "medoids"), "tags": saved(own.tags, "tags")}, self._of())
