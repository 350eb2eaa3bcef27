"""Operators on posts with tag arrays. Posts: id, username, retweet_count, hashtags, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.operators.order import quantile_marks


def flatten(tags: Column) -> Column:
    """array<struct<text>> as array<string>."""
    return F.transform(tags, lambda x: x["text"])


def wrap(tags: Column) -> Column:
    return F.transform(tags, lambda x: F.struct(x.alias("text")))


def exploded(posts: DataFrame, *columns: str) -> DataFrame:
    return posts.select(*(columns or ("id",)), F.posexplode("hashtags").alias("pos", "hashtag"))


def occurrences(posts: DataFrame) -> DataFrame:
    """(hashtag, count): in how many posts a tag stands."""
    return posts.select(F.explode(F.array_distinct("hashtags")).alias("hashtag")).groupBy("hashtag").agg(F.count("*").alias("count"))


def common(posts: DataFrame, least: int | DataFrame) -> DataFrame:
    """(hashtag): the tags that occur at least `least` times, repeats counting."""
    counts = posts.select(F.explode("hashtags").alias("hashtag")).groupBy("hashtag").agg(F.count("*").alias("n"))
    if isinstance(least, DataFrame):
        return counts.crossJoin(F.broadcast(least.toDF("_least"))).where("n >= _least").select("hashtag")
    return counts.where(F.col("n") >= least).select("hashtag")


def rare_filter(posts: DataFrame, least: int | DataFrame) -> DataFrame:
    """Arrays without tags that occur fewer than `least` times (repeats count); posts left without a tag go.

    least may be a table of one number, so that it can be a share of a table without counting it beforehand.
    """
    flat, kept = exploded(posts), common(posts, least)
    kept = flat.join(kept, "hashtag", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "hashtag"))).alias("t"))
    return posts.drop("hashtags").join(kept.select("id", F.transform("t", lambda x: x["hashtag"]).alias("hashtags")), "id")


def limit_occurrences(counts: DataFrame, limit: int) -> DataFrame:
    return counts.where(F.col("count") > limit)


def expected(posts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Posts whose tags are cut to the allowed ones; posts left without a tag go."""
    kept = exploded(posts).join(allowed.select("hashtag"), "hashtag", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "hashtag"))).alias("t"))
    return kept.select("id", F.transform("t", lambda x: x["hashtag"]).alias("hashtags"))


def first_by(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """One row of each key: the first in a declared order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def cooccurrence(posts: DataFrame) -> DataFrame:
    """(tag, other, posts): distinct ordered pairs within a post."""
    flat = posts.select("id", F.explode(F.array_distinct("hashtags")).alias("tag"))
    pairs = flat.join(flat.withColumnRenamed("tag", "other"), "id").where("tag <> other")
    return pairs.groupBy("tag", "other").agg(F.count("*").alias("posts"))


def user_popularity(posts: DataFrame) -> DataFrame:
    return posts.groupBy("username").agg(F.avg("retweet_count").alias("popularity"))


def popularity_bins(users: DataFrame, bins: int = 8) -> DataFrame:
    """Right-closed quantile bins of popularity; equal edges count once."""
    marks = quantile_marks(users, "popularity", [i / bins for i in range(bins + 1)], "username")
    edges = marks.agg(F.sort_array(F.collect_set("mark")).alias("edges"))
    below = F.size(F.filter("edges", lambda e: e < F.col("popularity")))
    return users.crossJoin(F.broadcast(edges)).select("username", "popularity", (F.greatest(below, F.lit(1)) - 1).alias("bin"))


def stratified(users: DataFrame, share: float = 0.7) -> DataFrame:
    """(username, bin, part): within each bin the first `share` by hash are train; users never shared are all train."""
    popular = popularity_bins(users.where("popularity > 0"))
    order = Window.partitionBy("bin").orderBy(F.md5("username"))
    ranked = popular.withColumn("n", F.row_number().over(order)).withColumn("of", F.count("*").over(Window.partitionBy("bin")))
    split = ranked.select("username", "bin", F.when(F.col("n") <= F.floor(F.col("of") * share), "train").otherwise("test").alias("part"))
    return split.unionByName(users.where("popularity = 0").select("username", F.lit(-1).alias("bin"), F.lit("train").alias("part")))
