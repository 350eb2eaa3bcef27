"""Registered queries: scans, projections, filters, joins, aggregates, ranking, sampling, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import text
from tagweave.operators import hashtags as H
from tagweave.operators.order import in_order
from tagweave.plans import views as V
from tagweave.plans.registry import register
from tagweave.plans.views import sql, table

q = register


@q("scan_tweets", sql("ev", "SELECT id, username, retweet_count, array_to_string(hashtags, ',') AS tags FROM ev"))
def _(s, d):
    return V.events(s, d).select("id", "username", "retweet_count", F.array_join("hashtags", ",").alias("tags"))


@q("scan_projected", "SELECT event_id, user_id FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", "user_id")


@q("filter_status", "SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def _(s, d):
    return table(s, d, "events").where("event_type = 'click'").select("event_id", "event_type")


@q("graph_nodes_by_type", sql("evflat", "WITH n AS (SELECT CAST(id AS VARCHAR) AS node, 'tweet' AS node_type FROM ev UNION ALL SELECT DISTINCT hashtag, 'hashtag' FROM evflat) SELECT node, node_type FROM n WHERE node_type = 'hashtag'"))
def _(s, d):
    e = V.events(s, d)
    nodes = e.select(F.col("id").cast("string").alias("node"), F.lit("tweet").alias("node_type")).unionByName(e.select(F.explode("hashtags").alias("node")).distinct().withColumn("node_type", F.lit("hashtag")))
    return nodes.where("node_type = 'hashtag'")


@q("scan_embeddings", "SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(len(embedding) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.size("embedding").cast("long").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@q("project_columns", "SELECT event_id, user_id, event_type FROM events")
def _(s, d):
    return table(s, d, "events").drop("ts", "value", "props")


@q("rename_columns", "SELECT event_id AS id, user_id AS author FROM events")
def _(s, d):
    return table(s, d, "events").withColumnsRenamed({"event_id": "id", "user_id": "author"}).select("id", "author")


@q("hashtags_flatten", sql("ev", "SELECT id, array_to_string(hashtags, ',') AS tags FROM ev"))
def _(s, d):
    e = V.events(s, d).withColumn("hashtags", H.wrap(F.col("hashtags")))
    return e.select("id", F.array_join(H.flatten(F.col("hashtags")), ",").alias("tags"))


@q("hashtags_distinct", sql("od", "SELECT id, array_to_string(hashtags, ',') AS tags FROM od"))
def _(s, d):
    return V.orders(s, d).select("id", F.array_join(F.array_sort(F.array_distinct("hashtags")), ",").alias("tags"))


@q("filter_nonempty", sql("dc", "SELECT id, CAST(len(hashtags) AS BIGINT) AS n FROM dc WHERE len(hashtags) > 0"))
def _(s, d):
    return V.documents(s, d).where(F.size("hashtags") > 0).select("id", F.size("hashtags").cast("long").alias("n"))


@q("filter_min_tokens", sql("dc", "SELECT id, CAST(len(lemmas) AS BIGINT) AS n FROM dc WHERE len(lemmas) > 1"))
def _(s, d):
    return V.documents(s, d).where(F.size("lemmas") > 1).select("id", F.size("lemmas").cast("long").alias("n"))


@q("split_popular", sql("ev", "SELECT id, CASE WHEN retweet_count > 0 THEN 'popular' ELSE 'unpopular' END AS part FROM ev"))
def _(s, d):
    e = V.events(s, d)
    return e.where("retweet_count > 0").select("id", F.lit("popular").alias("part")).unionByName(e.where("retweet_count = 0").select("id", F.lit("unpopular").alias("part")))


@q("drop_null_embedding", sql("ev", "SELECT id FROM ev LEFT JOIN embeddings ON vec_id = id % 700 WHERE embedding IS NOT NULL"))
def _(s, d):
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    return V.events(s, d).join(v, F.col("vec_id") == F.col("id") % 700, "left").na.drop(subset=["embedding"]).select("id")


@q("dedupe_first", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1")
def _(s, d):
    return H.first_by(table(s, d, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id")


@q("dedupe_hashtag_set", sql("ev", "SELECT id, tags FROM (SELECT id, array_to_string(list_sort(list_distinct(list_transform(hashtags, lambda x: lower(x)))), '|') AS tags, row_number() OVER (PARTITION BY array_to_string(list_sort(list_distinct(list_transform(hashtags, lambda x: lower(x)))), '|') ORDER BY id) AS n FROM ev) WHERE n = 1"))
def _(s, d):
    tags = F.array_join(F.array_sort(F.array_distinct(F.transform("hashtags", F.lower))), "|")
    return H.first_by(V.events(s, d).select("id", tags.alias("tags")), ["tags"], ["id"])


@q("add_constant", "SELECT event_id, 'events' AS dataset, event_id AS copy FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id").withColumn("dataset", F.lit("events")).withColumn("copy", F.col("event_id"))


@q("expected_hashtags", sql("od", "WITH f AS (SELECT id, unnest(hashtags) AS h, generate_subscripts(hashtags, 1) AS pos FROM od) SELECT id, array_to_string(list(h ORDER BY pos), ',') AS tags FROM f WHERE h LIKE 'E%' GROUP BY id"))
def _(s, d):
    o = V.orders(s, d)
    allowed = o.select(F.explode("hashtags").alias("hashtag")).distinct().where("hashtag like 'E%'")
    return H.expected(o, allowed).select("id", F.array_join("hashtags", ",").alias("tags"))


@q("exists_in_array", sql("ev", "SELECT id FROM ev WHERE len(list_filter(hashtags, lambda x: lower(x) = 'click' OR contains(x, 'k9'))) > 0"))
def _(s, d):
    return V.events(s, d).where(F.exists("hashtags", lambda x: (F.lower(x) == "click") | x.contains("k9"))).select("id")


@q("join_embeddings", sql("ev emb", "SELECT ev.id, a.label::BIGINT AS la, b.label::BIGINT AS lb FROM ev JOIN emb a ON a.vec_id = id % (SELECT count(*) FROM embeddings) JOIN emb b ON b.vec_id = (id + 1) % (SELECT count(*) FROM embeddings)"))
def _(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    e, n = V.events(s, d).select("id", (F.col("id") + 1).alias("after")), V.size(v)
    a, b = v.toDF("va", "la"), v.toDF("vb", "lb")
    return V.modulo(V.modulo(e, n, "id", "va"), n, "after", "vb").join(a, "va").join(b, "vb").select("id", "la", "lb")


@q("join_lemmas", sql("ev tok", "WITH e AS (SELECT id, id % (SELECT count(*) FROM documents) AS d FROM ev) SELECT CAST(id AS VARCHAR) AS id_str, CAST(d AS VARCHAR) AS doc_temp, CAST(len(toks) AS BIGINT) AS n FROM e JOIN tok ON CAST(doc_id AS VARCHAR) = CAST(d AS VARCHAR)"))
def _(s, d):
    docs = table(s, d, "documents")
    e = V.modulo(V.events(s, d).select("id"), V.size(docs), "id", "doc").select(F.col("id").cast("string").alias("id_str"), F.col("doc").cast("string").alias("doc"))
    t = docs.select(F.col("doc_id").cast("string").alias("doc_temp"), F.size(text.tokens(F.col("text"))).cast("long").alias("n"))
    return e.join(t, F.col("doc") == F.col("doc_temp")).select("id_str", "doc_temp", "n")


@q("semi_join_nodes", sql("evf", "SELECT id FROM ev SEMI JOIN evk USING (id)"))
def _(s, d):
    return V.events(s, d).join(V.common_events(s, d).select("id"), "id", "left_semi").select("id")


@q("semi_join_both", sql("ev", "SELECT id FROM ev WHERE username IN (SELECT username FROM ev GROUP BY 1 HAVING avg(retweet_count) > 2) AND id IN (SELECT vec_id FROM embeddings)"))
def _(s, d):
    e = V.events(s, d)
    return e.join(H.user_popularity(e).where("popularity > 2"), "username", "left_semi").join(table(s, d, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_semi").select("id")


@q("hashtag_counts_join", sql("evflat", "WITH c AS (SELECT hashtag, count(DISTINCT id) AS n FROM evflat GROUP BY 1), t AS (SELECT DISTINCT hashtag FROM evflat) SELECT hashtag, n FROM t JOIN c USING (hashtag)"))
def _(s, d):
    e = V.events(s, d)
    return e.select(F.explode("hashtags").alias("hashtag")).distinct().join(H.occurrences(e), "hashtag").select("hashtag", F.col("count").alias("n"))


_PAIRS = "WITH f AS (SELECT id, unnest(hashtags) AS tag FROM od), p AS (SELECT a.tag, b.tag AS other, count(*) AS posts FROM f a JOIN f b ON a.id = b.id AND a.tag <> b.tag GROUP BY 1, 2) "


@q("cooccurrence_pairs", sql("od", _PAIRS + "SELECT * FROM p"))
def _(s, d):
    return H.cooccurrence(V.orders(s, d))


@q("cooccurrence_sets", sql("od", _PAIRS + "SELECT tag, count(*) AS n, string_agg(other, ',' ORDER BY other) AS others FROM p GROUP BY tag"))
def _(s, d):
    p = H.cooccurrence(V.orders(s, d))
    return p.groupBy("tag").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("other")), ",").alias("others"))


@q("cooccurrence_graph", sql("od", _PAIRS + "SELECT tag, count(*) AS degree FROM p GROUP BY tag"))
def _(s, d):
    return H.cooccurrence(V.orders(s, d)).groupBy("tag").agg(F.count("*").alias("degree"))


@q("rare_hashtag_filter", sql("evf", "SELECT id, array_to_string(hashtags, ',') AS tags FROM evf"))
def _(s, d):
    return V.common_events(s, d).select("id", F.array_join("hashtags", ",").alias("tags"))


@q("hashtag_occurrences", sql("dcflat", "SELECT hashtag, count(DISTINCT id) AS n FROM dcflat GROUP BY 1"))
def _(s, d):
    return H.occurrences(V.documents(s, d)).select("hashtag", F.col("count").alias("n"))


@q("hashtag_limit", sql("dcflat", "SELECT hashtag, count(DISTINCT id) AS n FROM dcflat GROUP BY 1 HAVING count(DISTINCT id) > 3"))
def _(s, d):
    return H.limit_occurrences(H.occurrences(V.documents(s, d)), 3).select("hashtag", F.col("count").alias("n"))


@q("hashtag_mean_retweets", sql("evf", "SELECT hashtag, round(avg(retweet_count), 6) AS mean_retweets FROM (SELECT DISTINCT id, hashtag FROM evk) JOIN ev USING (id) GROUP BY hashtag"))
def _(s, d):
    e = V.common_events(s, d)
    return e.select("id", "retweet_count", F.explode("hashtags").alias("hashtag")).distinct().groupBy("hashtag").agg(F.round(F.avg("retweet_count"), 6).alias("mean_retweets"))


@q("user_popularity", sql("ev", "SELECT username, round(avg(retweet_count), 6) AS popularity FROM ev GROUP BY 1"))
def _(s, d):
    return H.user_popularity(V.events(s, d)).select("username", F.round("popularity", 6).alias("popularity"))


@q("tag_distinct_tweets", sql("evflat", "SELECT hashtag, count(DISTINCT id) AS n FROM evflat GROUP BY 1"))
def _(s, d):
    return H.exploded(V.events(s, d)).groupBy("hashtag").agg(F.count_distinct("id").alias("n"))


@q("describe_counts", sql("evflat", "WITH c AS (SELECT hashtag, count(*) AS n FROM evflat GROUP BY 1) SELECT count(*) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS low, quantile_cont(n, 0.25)::DOUBLE AS p25, quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.75)::DOUBLE AS p75, round(quantile_cont(n, 0.95)::DOUBLE, 6) AS p95, round(quantile_cont(n, 0.99)::DOUBLE, 6) AS p99, max(n) AS high FROM c"))
def _(s, d):
    c = H.exploded(V.events(s, d)).groupBy("hashtag").agg(F.count("*").alias("n"))
    p = F.percentile("n", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95, 0.99)]))
    out = c.agg(F.count("*").alias("c"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("low"), p.alias("p"), F.max("n").alias("high"))
    return out.select(F.col("c").alias("n"), "mean", "std", "low", *[F.round(F.col("p")[i], 6).alias(f"p{x}") for i, x in enumerate((25, 50, 75, 95, 99))], "high")


@q("degree_stats", sql("od", _PAIRS.rstrip() + ", g AS (SELECT tag, count(*) AS degree FROM p GROUP BY tag) SELECT degree, count(*) AS nodes, (SELECT min(degree) FROM g) AS low, (SELECT max(degree) FROM g) AS high FROM g GROUP BY degree"))
def _(s, d):
    g = H.cooccurrence(V.orders(s, d)).groupBy("tag").agg(F.count("*").alias("degree"))
    return g.groupBy("degree").agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(g.agg(F.min("degree").alias("low"), F.max("degree").alias("high"))))


@q("tag_totals", sql("dc", "SELECT CAST(sum(len(hashtags)) AS BIGINT) AS total, (SELECT count(DISTINCT h) FROM (SELECT unnest(hashtags) AS h FROM dc)) AS tags FROM dc"))
def _(s, d):
    x = V.documents(s, d)
    return x.agg(F.sum(F.size("hashtags")).cast("long").alias("total")).crossJoin(x.select(F.explode("hashtags").alias("h")).agg(F.count_distinct("h").alias("tags")))


@q("length_histogram", "SELECT CAST(floor(ln(1 + n_chars)) AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").groupBy(F.floor(F.log1p("n_chars")).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@q("latest_snapshot", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts) DESC, event_id) AS n FROM events) WHERE n = 1")
def _(s, d):
    from tagweave.sources.records import latest

    return latest(table(s, d, "events").withColumn("h", F.date_trunc("hour", "ts")), "user_id", "h", "event_id").select("user_id", "event_id", "event_type")


@q("popularity_bins", sql("ev", """WITH u AS (SELECT username, avg(retweet_count) AS x FROM ev GROUP BY 1 HAVING avg(retweet_count) > 0), e AS (SELECT DISTINCT unnest(quantile_cont(x, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1])) AS edge FROM u)
 SELECT username, CAST(greatest((SELECT count(*) FROM e WHERE edge < x), 1) - 1 AS BIGINT) AS bin FROM u"""))
def _(s, d):
    return H.popularity_bins(H.user_popularity(V.events(s, d)).where("popularity > 0")).select("username", F.col("bin").cast("long").alias("bin"))


@q("stratified_split", sql("ev", """WITH u AS (SELECT username, avg(retweet_count) AS x FROM ev GROUP BY 1), e AS (SELECT DISTINCT unnest(quantile_cont(x, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1])) AS edge FROM u WHERE x > 0),
 b AS (SELECT username, greatest((SELECT count(*) FROM e WHERE edge < x), 1) - 1 AS bin FROM u WHERE x > 0), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(username)) AS n, count(*) OVER (PARTITION BY bin) AS c FROM b)
 SELECT username, CAST(bin AS BIGINT) AS bin, CASE WHEN n <= floor(c * 0.7e0) THEN 'train' ELSE 'test' END AS part FROM r UNION ALL SELECT username, -1, 'train' FROM u WHERE x = 0"""))
def _(s, d):
    return H.stratified(H.user_popularity(V.events(s, d))).withColumn("bin", F.col("bin").cast("long"))


@q("explode_sorted", sql("evflat", "SELECT id, pos - 1 AS pos, hashtag FROM evflat"))
def _(s, d):
    return H.exploded(V.events(s, d)).orderBy("id", "pos").select("id", F.col("pos").cast("long").alias("pos"), "hashtag")


@q("label_order", sql("dcflat", "SELECT hashtag, row_number() OVER (ORDER BY hashtag) AS n FROM (SELECT DISTINCT hashtag FROM dcflat)"))
def _(s, d):
    return in_order(V.documents(s, d).select(F.explode("hashtags").alias("hashtag")).distinct(), "hashtag")


@q("label_index", sql("evflat", "SELECT hashtag, dense_rank() OVER (ORDER BY hashtag) - 1 AS idx FROM (SELECT DISTINCT hashtag FROM evflat)"))
def _(s, d):
    labels = V.events(s, d).select(F.explode("hashtags").alias("hashtag")).distinct()
    return in_order(labels, "hashtag").select("hashtag", (F.col("n") - 1).alias("idx"))


@q("sample_by_hash", "SELECT event_id FROM events WHERE substr(md5(CAST(user_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3')")
def _(s, d):
    return table(s, d, "events").where(F.substring(F.md5(F.col("user_id").cast("string")), 1, 1).isin("0", "1", "2", "3")).select("event_id")


@q("random_baseline", sql("evflat", "WITH t AS (SELECT hashtag, row_number() OVER (ORDER BY hashtag) AS i FROM (SELECT DISTINCT hashtag FROM evflat)), w AS (SELECT id AS query, unnest(range(1, 6)) AS rank FROM ev) SELECT query, CAST(rank AS INTEGER) AS rank, hashtag FROM w JOIN t ON i = CAST('0x' || md5('1337|' || query || '|' || rank)[1:8] AS BIGINT) % (SELECT count(*) FROM t) + 1"))
def _(s, d):
    from tagweave.plans.recommend import random_tags

    return random_tags(V.events(s, d).select(F.col("id").alias("query")), V.events(s, d).select(F.explode("hashtags").alias("hashtag")).distinct(), 5, 1337)


@q("union_originals", "SELECT event_id AS id, 'original' AS kind FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, 'again' FROM events WHERE event_type = 'view'")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("id"), "event_type")
    return e.where("event_type <> 'view'").select("id", F.lit("original").alias("kind")).unionByName(e.where("event_type = 'view'").select("id", F.lit("again").alias("kind")))


@q("distinct_labels", sql("evflat", "SELECT DISTINCT hashtag FROM evflat"))
def _(s, d):
    return V.events(s, d).select(F.explode("hashtags").alias("hashtag")).distinct()


@q("edges_distinct", sql("evflat", "SELECT DISTINCT id, hashtag FROM evflat"))
def _(s, d):
    return V.events(s, d).select("id", F.explode("hashtags").alias("hashtag")).distinct()


@q("explode_tags", sql("od", "SELECT id, unnest(hashtags) AS hashtag FROM od"))
def _(s, d):
    return V.orders(s, d).select("id", F.explode("hashtags").alias("hashtag"))


@q("explode_text_per_tag", sql("dc", "SELECT id, unnest(hashtags) AS hashtag, array_to_string(lemmas, ' ') AS text FROM dc"))
def _(s, d):
    return V.documents(s, d).select("id", F.explode("hashtags").alias("hashtag"), F.array_join("lemmas", " ").alias("text"))


def _fn(name: str, spark_expr, duck: str, source: str = "documents", key: str = "doc_id") -> None:
    @q(f"fn_{name}", f"SELECT {key}, {duck} FROM {source}")
    def _(s, d):
        return table(s, d, source).select(key, *spark_expr())


_fn("lower", lambda: [F.lower(F.col("lang")).alias("x"), F.lower(F.col("source")).alias("y")], "lower(lang) AS x, lower(source) AS y")
_fn("split_first", lambda: [text.split_first(F.col("text"), ".").alias("x")], "split_part(text, '.', 1) AS x")
_fn("key_value", lambda: [text.key_of(F.concat_ws(":", "lang", "source")).alias("k"), text.value_of(F.concat_ws(": ", "lang", "source")).alias("v")], "lang AS k, source AS v")
_fn("split_ws", lambda: [F.size(text.split_ws(F.trim("text"))).cast("long").alias("n")], r"CAST(len(regexp_split_to_array(trim(text), '\s+')) AS BIGINT) AS n")
_fn("split_space", lambda: [F.size(F.split("text", " ")).cast("long").alias("n")], "CAST(len(string_split(text, ' ')) AS BIGINT) AS n")
_fn("join", lambda: [F.array_join(F.array("lang", "source"), " ").alias("x")], "lang || ' ' || source AS x")
_fn("clean_lemmas", lambda: [F.array_join(text.clean_lemmas(F.split("text", " ")), " ").alias("x")], r"array_to_string(list_filter(list_transform(string_split(text, ' '), lambda x: trim(regexp_replace(x, '[!-/:-@\[-`{-~]', '', 'g'))), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')), ' ') AS x")
_fn("strip_quotes", lambda: [text.strip_quotes(F.col("text")).alias("x")], "translate(text, chr(39) || chr(34), '') AS x")
_fn("valid_chars", lambda: [text.valid_chars(F.col("text")).alias("x")], r"regexp_replace(text, '[^\x20-\x7Eąćęłńóśźż ĄĆĘŁŃÓŚŹŻ]', '', 'g') AS x")
_fn("lengths", lambda: [F.length("text").cast("long").alias("chars"), F.size(F.split("text", " ")).cast("long").alias("parts")], "CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, ' ')) AS BIGINT) AS parts")
_fn("cast", lambda: [F.col("doc_id").cast("string").alias("s"), F.expr("try_cast(substring(source, 4) as bigint)").alias("n")], "CAST(doc_id AS VARCHAR) AS s, TRY_CAST(substr(source, 4) AS BIGINT) AS n")
_fn("log1p", lambda: [F.round(F.log1p("n_chars"), 6).alias("x")], "round(ln(1 + n_chars), 6) AS x")


@q("fn_parse_ts", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events")
def _(s, d):
    shown = F.concat(F.lit("Mon "), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy"))
    return table(s, d, "events").select("event_id", F.unix_timestamp(text.parse_created(shown)).alias("t"))


@q("fn_tokenise_entities")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.tokenise_entities(F.col("text")).alias("text"))


@q("fn_clean_entities")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.clean_entities(F.col("text")).alias("text"))
