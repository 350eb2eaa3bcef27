"""Post views over the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import text
from tagweave.operators import hashtags
from tagweave.sources.store import saved

TAGS = 5


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def modulo(rows: DataFrame, n: DataFrame, by: str, to: str) -> DataFrame:
    """rows with `to`, the column `by` modulo the one number that n holds."""
    return rows.crossJoin(F.broadcast(n.toDF("_n"))).withColumn(to, F.col(by) % F.col("_n")).drop("_n")


def size(t: DataFrame) -> DataFrame:
    return t.agg(F.count("*").alias("_n"))


def events(spark: SparkSession, d: str, lemmas: bool = False, embedding: bool = False) -> DataFrame:
    e = table(spark, d, "events")
    count = F.when(F.col("user_id") % 5 == 0, 0).otherwise(F.floor(F.col("value") / 10)).cast("long")
    tags = F.array("event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k")))
    out = e.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("username"), F.col("ts").alias("created_at"), count.alias("retweet_count"), tags.alias("hashtags"))
    if lemmas:
        t = table(spark, d, "documents")
        docs = t.select(F.col("doc_id").alias("_d"), text.tokens(F.col("text")).alias("lemmas"))
        out = modulo(out, size(t), "id", "_d").join(docs, "_d").drop("_d")
    return with_embedding(spark, d, out) if embedding else out


def with_embedding(spark: SparkSession, d: str, posts: DataFrame) -> DataFrame:
    t = table(spark, d, "embeddings")
    v = t.select(F.col("vec_id").alias("_v"), F.col("embedding").cast("array<double>").alias("embedding"))
    return modulo(posts, size(t), "id", "_v").join(v, "_v").drop("_v")


def orders(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    agg = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("retweet_count"), F.array_sort(F.collect_set(F.concat("p_type", F.lit("_"), "p_brand"))).alias("hashtags"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("username"), F.col("o_orderdate").alias("created_at")).join(agg, "id")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Posts made of documents: all tokens are lemmas; tags are the TAGS distinct tokens of the text that come first by md5."""
    t = table(spark, d, "documents").select("doc_id", "source", "n_chars", text.tokens(F.col("text")).alias("_t"))
    by_hash = F.array_sort(F.transform(F.array_distinct(F.filter("_t", lambda x: F.length(x) >= 4)), lambda x: F.concat(F.md5(x.cast("binary")), x)))
    tags = F.array_sort(F.transform(F.slice(by_hash, 1, TAGS), lambda x: F.substring(x, 33, 1 << 20)))
    return t.select(F.col("doc_id").alias("id"), F.col("source").alias("username"), (F.col("n_chars") % 7).alias("retweet_count"), tags.alias("hashtags"), F.col("_t").alias("lemmas"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    """documents(), saved: what reads it several times cuts and hashes the texts once."""
    return saved(documents(spark, d), "posts")


def common_events(spark: SparkSession, d: str, lemmas: bool = False, embedding: bool = False) -> DataFrame:
    """events() without rare tags; vectors join last, so that no shuffle carries them."""
    least = size(table(spark, d, "events")).select(F.expr("_n div 100"))
    posts = hashtags.rare_filter(events(spark, d, lemmas), least)
    return with_embedding(spark, d, posts) if embedding else posts


def common_documents(spark: SparkSession, d: str) -> DataFrame:
    return hashtags.rare_filter(posts(spark, d), 3)


def word_vectors(spark: SparkSession, d: str, made: DataFrame | None = None, kind: str = "array<double>") -> DataFrame:
    """Every word of the documents view with the vector whose id is the first 8 hex digits of its md5, modulo their number."""
    t = table(spark, d, "embeddings")
    words = (documents(spark, d) if made is None else made).select(F.explode("lemmas").alias("word")).distinct()
    words = words.withColumn("_h", F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 8), 16, 10).cast("long"))
    return modulo(words, size(t), "_h", "_v").join(t.select(F.col("vec_id").alias("_v"), F.col("embedding").cast(kind).alias("vector")), "_v").select("word", "vector")


_TOK = r"tok AS (SELECT doc_id, source, n_chars, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS toks FROM documents)"
_EV = """ev AS (SELECT event_id AS id, 'u' || user_id AS username, ts AS created_at, CAST(CASE WHEN user_id % 5 = 0 THEN 0 ELSE floor(value / 10) END AS BIGINT) AS retweet_count,
 [event_type, 'k' || regexp_extract(props, '"k": *([0-9]+)', 1)] AS hashtags FROM events)"""
_EVFLAT = "evflat AS (SELECT id, unnest(hashtags) AS hashtag, generate_subscripts(hashtags, 1) AS pos FROM ev)"
_EVOK = "evok AS (SELECT hashtag FROM evflat GROUP BY hashtag HAVING count(*) >= (SELECT count(*) // 100 FROM events)), evk AS (SELECT * FROM evflat SEMI JOIN evok USING (hashtag)), evf AS (SELECT ev.* EXCLUDE (hashtags), k.hashtags FROM ev JOIN (SELECT id, list(hashtag ORDER BY pos) AS hashtags FROM evk GROUP BY id) k USING (id))"
_EMB = "emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_EVE = "eve AS (SELECT evf.*, v AS embedding FROM evf JOIN emb ON id % (SELECT count(*) FROM embeddings) = vec_id)"
_OD = """od AS (SELECT o_orderkey AS id, 'c' || o_custkey AS username, o_orderdate AS created_at, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS retweet_count,
 list_sort(list_distinct(list(p_type || '_' || p_brand))) AS hashtags FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey, o_custkey, o_orderdate)"""
_DC = "dc AS (SELECT doc_id AS id, source AS username, n_chars % 7 AS retweet_count, list_sort(list_transform(list_sort(list_transform(list_distinct(list_filter(toks, lambda x: length(x) >= 4)), lambda x: md5(x) || x))[1:5], lambda x: x[33:])) AS hashtags, toks AS lemmas FROM tok)"
_DCFLAT = "dcflat AS (SELECT id, unnest(hashtags) AS hashtag, generate_subscripts(hashtags, 1) AS pos FROM dc)"
_DCF = "dcok AS (SELECT hashtag FROM dcflat GROUP BY hashtag HAVING count(*) >= 3), dck AS (SELECT * FROM dcflat SEMI JOIN dcok USING (hashtag)), dcf AS (SELECT dc.* EXCLUDE (hashtags), k.hashtags FROM dc JOIN (SELECT id, list(hashtag ORDER BY pos) AS hashtags FROM dck GROUP BY id) k USING (id))"
_WV = "vocab AS (SELECT DISTINCT unnest(lemmas) AS word FROM dc), wv AS (SELECT word, v AS vector FROM (SELECT word, CAST('0x' || md5(word)[1:8] AS BIGINT) % (SELECT count(*) FROM embeddings) AS r FROM vocab) JOIN emb ON r = vec_id)"
_BASE = {
    "ev": [_EV], "evflat": [_EV, _EVFLAT], "evf": [_EV, _EVFLAT, _EVOK], "eve": [_EV, _EVFLAT, _EVOK, _EMB, _EVE], "od": [_OD], "dc": [_TOK, _DC], "dcflat": [_TOK, _DC, _DCFLAT],
    "dcf": [_TOK, _DC, _DCFLAT, _DCF], "wv": [_TOK, _DC, _EMB, _WV], "emb": [_EMB], "tok": [_TOK],
}


def sql(views: str, body: str) -> str:
    """body, with the named views before it."""
    parts: list[str] = []
    for v in views.split():
        parts += [p for p in _BASE[v] if p not in parts]
    body = body.strip()
    return f"WITH {', '.join(parts)}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"
