"""The recommenders: each takes DataFrames and returns (query, rank, hashtag, score)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from tagweave.functions import grams
from tagweave.functions.vectors import angular_similarity, cosine
from tagweave.operators import density, embed, graph, hashtags, tfidf
from tagweave.operators.order import in_order
from tagweave.sources.store import saved

SCORE_DIGITS = 9


def ranked(scores: DataFrame, score: Column | None = None, k: int | None = None, rising: bool = False) -> DataFrame:
    """Ranks by score, rounded so that equal ones tie alike everywhere, then by tag."""
    value = F.round(score if score is not None else F.col("score"), SCORE_DIGITS)
    order = Window.partitionBy("query").orderBy(value.asc() if rising else value.desc(), "hashtag")
    out = scores.withColumn("score", value).withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= k) if k else out).select("query", "rank", "hashtag", "score")


def minmax(column: str, key: list[str] | None = None) -> Column:
    w = Window.partitionBy(*(key or ["query"]))
    return (F.col(column) - F.min(column).over(w)) / (F.max(column).over(w) - F.min(column).over(w) + 1e-18)


class Popularity:
    """Similarity of a query to each tag's profile, mixed with the tag's popularity.

    ratio 0 is pure similarity, 1 pure popularity; popularity is mean_retweets or pagerank. The profile has one row a
    tag; Spark broadcasts it where it is below the session's threshold, and shuffles nothing of the queries then.
    """

    def __init__(self, ratio: float = 0.4, popularity: str = "mean_retweets", least: int = 10, is_weighted: bool = True, personalised: bool = True, steps: int | None = None, additive: bool = False):
        if not 0 <= ratio <= 1:
            raise ValueError("ratio must lie in [0, 1]")
        self.ratio, self.popularity, self.least = ratio, popularity, least
        self.is_weighted, self.personalised, self.steps, self.additive = is_weighted, personalised, steps, additive

    def fit(self, posts: DataFrame) -> Popularity:
        """posts (id, hashtags, embedding, retweet_count), an id once. Rare tags go where rows are read; no post is shuffled."""
        common = saved(hashtags.common(posts.where(F.size("hashtags") > 0), self.least), "common")
        posts = posts.na.drop(subset=["embedding"])
        self.profile = saved(graph.profile(posts, common), "profile")
        if self.popularity == "pagerank":
            ranks = graph.Ranks(posts, self.profile, self.is_weighted, self.personalised).run(steps=self.steps)
            self.profile = self.profile.join(F.broadcast(ranks.tags().withColumnRenamed("x", "pagerank")), "hashtag")
        return self

    def from_embeddings(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """queries (query, embedding); a null embedding is ranked by popularity alone."""
        both = queries.crossJoin(self.profile.withColumnRenamed("embedding", "profile"))
        both = both.withColumn("sim", F.coalesce(angular_similarity(F.col("embedding"), F.col("profile")), F.lit(0.0))).withColumn("pop", F.col(self.popularity))
        r = F.lit(self.ratio)
        mixed = F.col("s") + r * F.col("p") if self.additive else (1 - r) * F.col("s") + r * F.col("p")
        return ranked(both.withColumn("s", minmax("sim")).withColumn("p", minmax("pop")), mixed, k)

    def from_lemmas(self, queries: DataFrame, vectors: DataFrame, k: int | None = None) -> DataFrame:
        means = embed.mean_embedding(queries.withColumnRenamed("query", "id"), vectors)
        return self.from_embeddings(means.withColumnRenamed("id", "query"), k)

    def from_text(self, queries: DataFrame, vectors: DataFrame, lemmatise, k: int | None = None) -> DataFrame:
        """lemmatise: a function from the text column to an array of lemmas."""
        return self.from_lemmas(queries.select("query", lemmatise(F.col("text")).alias("lemmas")), vectors, k)


class GraphWalk:
    """TF-IDF similarity times a random walk with restart on the graph of tags that share posts and users."""

    def __init__(self, damping: float = 0.8, threshold: float = 1e-4, most: int = 100, least: int = 3, steps: int | None = None):
        self.damping, self.threshold, self.most, self.least, self.steps = damping, threshold, most, least, steps

    def fit(self, posts: DataFrame) -> GraphWalk:
        posts = saved(hashtags.rare_filter(posts, self.least), "posts")
        self.edges = saved(graph.tripartite(posts), "edges")
        self.documents = saved(tfidf.tag_documents(posts), "documents")
        self.idf = saved(tfidf.idf(self.documents), "idf")
        self.weights = saved(tfidf.weights(self.documents, self.idf), "weights")
        self.tags = saved(self.edges.select("hashtag").distinct(), "tags")
        return self

    def _tiles(self, queries: DataFrame, walks: graph.Walks | None = None) -> tfidf.Tiles:
        walks = walks or graph.Walks(self.edges, self.damping)
        return tfidf.Tiles(queries, tfidf.query_weights(queries, self.idf), self.weights, walks.names, walks.numbers)

    def similarities(self, queries: DataFrame) -> DataFrame:
        """(query, hashtag, similarity) with a row for every tag."""
        return self._tiles(queries).rows()

    def preference(self, queries: DataFrame, scores: DataFrame | None = None) -> DataFrame:
        """(query, tag): the query's own tag where it is known, else the closest one. scores: vectors() of the tiles, if they are there already."""
        scores = self._tiles(queries).vectors(whole=False) if scores is None else scores
        closest = scores.groupBy("query").agg(F.min_by("hashtag", F.struct(-F.col("best"), "hashtag")).alias("closest"))
        if "tag" not in queries.columns:
            return closest.select("query", F.col("closest").alias("tag"))
        known = queries.join(self.tags, queries["tag"] == self.tags["hashtag"], "left_semi").select("query", "tag")
        return closest.join(known, "query", "left").select("query", F.coalesce("tag", "closest").alias("tag"))

    def from_lemmas(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        walks = graph.Walks(self.edges, self.damping)
        scores = saved(self._tiles(queries, walks).vectors(), "scores")
        blocks = walks.blocks(self.preference(queries, scores))
        steps = self.steps or walks.settled(blocks, self.threshold, self.most)
        arcs, damping = walks.arcs, self.damping

        def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(parts))
            query, start, low = table.column("query").combine_chunks(), table.column("start").to_numpy(), table.column("low").to_numpy()
            values, last = table.column("values").combine_chunks(), None
            _, own = np.unique(query.dictionary_encode().indices.to_numpy(), return_inverse=True)
            order = np.lexsort((low, own, start))
            for one in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                if start[one[0]] != last:
                    last, r = start[one[0]], graph._walked(arcs.value, start[one[0]], damping, steps)[0]
                score = np.round(values.take(pa.array(one)).flatten().to_numpy() * r, SCORE_DIGITS)
                top = np.argsort(-score, kind="stable")[:k]
                yield pa.record_batch([query.take(pa.array(np.full(len(top), one[0]))), pa.array(np.arange(1, len(top) + 1), pa.int32()), pa.array(arcs.value[0][top], pa.string()), pa.array(score[top])], ["query", "rank", "hashtag", "score"])

        both = scores.select("query", "low", "values").join(blocks, "query")
        kind = queries.schema["query"].dataType.simpleString()
        return both.repartition(blocks.rdd.getNumPartitions(), "block").groupBy("block").applyInArrow(best, f"query {kind}, rank int, hashtag string, score double")


class Clusters:
    """Density clusters of embeddings; a query gets the tags of the nearest medoids, cluster by cluster."""

    def __init__(self, neighbours: int = 16):
        self.neighbours = neighbours

    def fit(self, points: DataFrame, tags: DataFrame) -> Clusters:
        """points (id, embedding), tags (id, pos, hashtag)."""
        labels = density.clusters(points, self.neighbours)
        self.medoids = density.medoids(points, labels)
        self.tags = density.cluster_tags(tags, labels)
        return self

    def from_embeddings(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        m = self.medoids.select("cluster", F.col("embedding").alias("centre"))
        far = queries.crossJoin(m).withColumn("d", F.round(1 - cosine(F.col("embedding"), F.col("centre")), SCORE_DIGITS)).select("query", "cluster", "d")
        near = far.withColumn("c", F.row_number().over(Window.partitionBy("query").orderBy("d", "cluster")))
        both = near.join(self.tags.withColumnRenamed("rank", "t"), "cluster")
        out = both.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("c", "t"))).select("query", "rank", "hashtag", F.col("d").alias("score"))
        return out.where(F.col("rank") <= k) if k else out


class Characters:
    """Hashed character n-grams and a linear softmax over tags: text to ranked tags."""

    def __init__(self, features: int = 4096, classes: int | None = None):
        self.buckets, self.classes = features, classes

    def features(self, texts: DataFrame) -> DataFrame:
        """texts with counts of hashed trigrams instead of their text, a null one's none; as they are where that is done already.

        fit and transform pass over them several times: where both take the same texts, save them once.
        """
        from pyspark.ml.linalg import VectorUDT

        if "features" in texts.columns:
            return texts
        kept = [f for f in texts.schema.fields if f.name != "text"]
        schema = StructType([*kept, StructField("features", VectorUDT(), False)])
        size, names = self.buckets, [f.name for f in schema.fields]
        low = texts.withColumn("text", F.lower(F.make_valid_utf8("text")).cast("binary"))
        return low.mapInArrow(lambda batches: grams.with_features(batches, size, names), schema)

    def fit(self, posts: DataFrame) -> Characters:
        """posts (text, hashtag) or (features, hashtag). All tags are learned, or the commonest `classes` of them."""
        from pyspark.ml.classification import LogisticRegression

        top = in_order(posts.groupBy("hashtag").count(), F.desc("count"), F.col("hashtag"), name="label").withColumn("label", F.col("label").cast("double") - 1)
        self.labels = saved((top.where(F.col("label") < self.classes) if self.classes else top).select("hashtag", "label"), "labels")
        rows = posts.join(self.labels, "hashtag")
        if "features" not in rows.columns:
            rows = saved(self.features(rows.select("text", "label")), "features")
        self.model = LogisticRegression(maxIter=15, regParam=1e-3).fit(rows.select("features", "label"))
        return self

    def transform(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        p = self.model.transform(self.features(queries)).select("query", F.posexplode(vector_to_array("probability")).alias("label", "score"))
        return ranked(p.join(self.labels, "label"), None, k)


def random_tags(queries: DataFrame, tags: DataFrame, k: int, seed: int) -> DataFrame:
    """k tags for each query, with replacement, by md5 of seed, query and draw; the same seed gives the same tags."""
    numbered = in_order(tags.select("hashtag"), "hashtag", name="i")
    n = tags.agg(F.count("*").alias("n"))
    draws = queries.select("query", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")).crossJoin(F.broadcast(n))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query").cast("string"), F.col("rank").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return draws.withColumn("i", drawn % F.col("n") + 1).join(numbered, "i").select("query", "rank", "hashtag")
