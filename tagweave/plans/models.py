"""Registered queries: vectors, graphs, embeddings, TF-IDF, density clusters, recommenders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import vectors as X
from tagweave.operators import density, embed, graph, hashtags, tfidf
from tagweave.plans import recommend as R
from tagweave.plans import views as V
from tagweave.plans.registry import register as q
from tagweave.plans.views import sql, table
from tagweave.sources.store import saved

_PAIR = "WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.v AS x, b.v AS y FROM emb a JOIN emb b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM embeddings)) "
_COS = "list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y)))"
_ANG = "1 - acos(greatest(least({}, 1e0), -1e0)) / pi()"


def _pairs(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    a, b = v.toDF("a", "x").withColumn("_s", F.col("a") * 7 + 1), v.toDF("b", "y")
    return V.modulo(a, V.size(v), "_s", "b").join(b, "b")


def _vector(name, make, duck):
    @q(f"fn_{name}", sql("emb", _PAIR + f"SELECT a, b, round({duck}, 6) AS value FROM p"))
    def _(s, d):
        return _pairs(s, d).select("a", "b", F.round(make(F.col("x"), F.col("y")), 6).alias("value"))


_vector("dot", X.dot, "list_inner_product(x, y)")
_vector("cosine", X.cosine, _COS)
_vector("angular", X.angular_similarity, _ANG.format(_COS))
_vector("l1", X.l1, "list_sum(list_transform(list_zip(x, y), lambda t: abs(t[1] - t[2])))")

_TAGE = "WITH te AS (SELECT hashtag, embedding, retweet_count FROM (SELECT DISTINCT id, hashtag FROM evk) JOIN eve USING (id)), tm AS (SELECT hashtag, pos, avg(x) AS m FROM (SELECT hashtag, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM te) GROUP BY 1, 2), prof AS (SELECT hashtag, list(m ORDER BY pos) AS e, any_value(r) AS mean_retweets FROM tm JOIN (SELECT hashtag, avg(retweet_count) AS r FROM te GROUP BY 1) USING (hashtag) GROUP BY hashtag) "
_EDGE = _TAGE.rstrip() + ", ew AS (SELECT id, hashtag, " + _ANG.format("list_inner_product(embedding, e) / (sqrt(list_inner_product(embedding, embedding)) * sqrt(list_inner_product(e, e)))") + " AS similarity FROM (SELECT DISTINCT id, hashtag FROM evk) JOIN eve USING (id) JOIN prof USING (hashtag)) "


def _posts(s, d):
    return V.with_embedding(s, d, saved(V.common_events(s, d), "posts"))


@q("hashtag_profile", sql("eve", _TAGE + "SELECT hashtag, pos - 1 AS pos, round(m, 6) AS m, round(r.mean_retweets, 6) AS mean_retweets FROM tm JOIN prof r USING (hashtag)"))
def _(s, d):
    p = graph.profile(_posts(s, d))
    return p.select("hashtag", F.posexplode("embedding").alias("pos", "m"), "mean_retweets").select("hashtag", F.col("pos").cast("long").alias("pos"), F.round("m", 6).alias("m"), F.round("mean_retweets", 6).alias("mean_retweets"))


@q("bipartite_edges", sql("evf", "SELECT DISTINCT id, hashtag FROM evk"))
def _(s, d):
    return graph.bipartite(V.common_events(s, d))


@q("edge_weights", sql("eve", _EDGE + "SELECT id, hashtag, round(similarity, 6) AS similarity, round(1 - similarity, 6) AS distance FROM ew"))
def _(s, d):
    p = _posts(s, d)
    return graph.weighted(p, saved(graph.profile(p), "profile")).select("id", "hashtag", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))


@q("edge_weight_range", sql("eve", _EDGE + "SELECT round(min(similarity), 6) AS low, round(max(similarity), 6) AS high, round(min(1 - similarity), 6) AS near, round(max(1 - similarity), 6) AS far FROM ew"))
def _(s, d):
    p = _posts(s, d)
    w = graph.weighted(p, saved(graph.profile(p), "profile"))
    return w.agg(F.round(F.min("similarity"), 6).alias("low"), F.round(F.max("similarity"), 6).alias("high"), F.round(F.min("distance"), 6).alias("near"), F.round(F.max("distance"), 6).alias("far"))


@q("graph_size", sql("evf", "SELECT (SELECT count(DISTINCT id) FROM evk) AS posts, (SELECT count(DISTINCT hashtag) FROM evk) AS tags, (SELECT count(*) FROM (SELECT DISTINCT id, hashtag FROM evk)) AS edges"))
def _(s, d):
    return graph.bipartite(V.common_events(s, d)).agg(F.count_distinct("id").alias("posts"), F.count_distinct("hashtag").alias("tags"), F.count("*").alias("edges"))


_STEP = "x{n} AS (SELECT nodes.node, 0.85e0 * coalesce(f, 0) + 0.15e0 * p AS x FROM nodes LEFT JOIN (SELECT dst, sum(w * x) AS f FROM arcs JOIN x{m} ON src = node GROUP BY dst) ON dst = node)"
_RANK = _EDGE.rstrip() + """, raw AS (SELECT 'p' || id AS src, 't' || hashtag AS dst, similarity AS w FROM ew UNION ALL SELECT 't' || hashtag, 'p' || id, similarity FROM ew), arcs AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM raw),
 nd AS (SELECT 'p' || id AS node, retweet_count + 1e0 AS q FROM eve UNION ALL SELECT 't' || hashtag, mean_retweets + 1e0 FROM prof), nodes AS (SELECT node, q / (SELECT sum(q) FROM nd) AS p FROM nd), x0 AS (SELECT node, 1e0 / (SELECT count(*) FROM nd) AS x FROM nodes), """ + ", ".join(_STEP.format(n=i + 1, m=i) for i in range(3)) + " "


def _ranks(s, d):
    """Ranks leave rare tags out themselves: no post is shuffled to drop them beforehand."""
    least = V.size(table(s, d, "events")).select(F.expr("_n div 100"))
    p, common = V.events(s, d, embedding=True), saved(hashtags.common(V.events(s, d), least), "common")
    return graph.Ranks(p, saved(graph.profile(p, common), "profile"))


@q("pagerank_iter_k", sql("eve", _RANK + "SELECT node, round(x, 9) AS x FROM x3"))
def _(s, d):
    return _ranks(s, d).run(steps=3).nodes().select("node", F.round("x", 9).alias("x"))


@q("pagerank")
def _(s, d):
    return _ranks(s, d).run().nodes()


_TRI = "WITH tri AS (SELECT DISTINCT hashtag, 'user' AS kind, username AS other FROM dck JOIN dc USING (id) UNION SELECT DISTINCT hashtag, 'tweet', CAST(id AS VARCHAR) FROM dck) "
_SHARED = _TRI.rstrip() + ", sh AS (SELECT a.hashtag AS i, b.hashtag AS j, count(*) AS w FROM tri a JOIN tri b ON a.kind = b.kind AND a.other = b.other AND a.hashtag <> b.hashtag GROUP BY 1, 2), dg AS (SELECT i AS j, CAST(sum(w) AS BIGINT) AS degree FROM sh GROUP BY i), tr AS (SELECT i, j, w / (degree + 1e-8) AS t FROM sh JOIN dg USING (j)) "


def _tri(s, d):
    return saved(graph.tripartite(V.common_documents(s, d)), "edges")


@q("tripartite_edges", sql("dcf", _TRI + "SELECT * FROM tri"))
def _(s, d):
    return _tri(s, d)


@q("tags_sharing_user", sql("dcf", _TRI + "SELECT DISTINCT a.hashtag AS i, b.hashtag AS j FROM tri a JOIN tri b ON a.other = b.other AND a.kind = 'user' AND b.kind = 'user' AND a.hashtag <> b.hashtag"))
def _(s, d):
    return graph.shared_neighbours(_tri(s, d).where("kind = 'user'")).select("i", "j")


@q("shared_neighbour_counts", sql("dcf", _SHARED + "SELECT i, j, w FROM sh"))
def _(s, d):
    return graph.shared_neighbours(_tri(s, d))


@q("weighted_degree", sql("dcf", _SHARED + "SELECT j AS tag, degree FROM dg"))
def _(s, d):
    return graph.weighted_degrees(_tri(s, d)).where("degree > 0").select("tag", "degree")


@q("transition_matrix", sql("dcf", _SHARED + "SELECT i, j, round(t, 9) AS t FROM tr"))
def _(s, d):
    return graph.transitions(_tri(s, d)).select("i", "j", F.round("t", 9).alias("t"))


_TF = """WITH td AS (SELECT hashtag, lower(token) AS token, count(*) AS tf FROM (SELECT hashtag, unnest(lemmas) AS token FROM dck JOIN dc USING (id)) WHERE length(token) >= 2 GROUP BY 1, 2), idf AS (SELECT token, ln((1e0 + (SELECT count(DISTINCT hashtag) FROM td)) / (1e0 + count(*))) + 1 AS idf FROM td GROUP BY token),
 wt AS (SELECT hashtag, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY hashtag)) AS weight FROM td JOIN idf USING (token)),
 qt AS (SELECT query, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query)) AS weight FROM (SELECT query, lower(token) AS token, count(*) AS tf FROM (SELECT id AS query, unnest(lemmas) AS token FROM dc WHERE id % 20 = 0) WHERE length(token) >= 2 GROUP BY 1, 2) JOIN idf USING (token)),
 sm AS (SELECT query, hashtag, sum(qt.weight * wt.weight) AS similarity FROM qt JOIN wt USING (token) GROUP BY 1, 2) """
_CLOSE = _TF.rstrip() + ", alltags AS (SELECT DISTINCT hashtag FROM dck), full_sm AS (SELECT q.query, hashtag, coalesce(similarity, 0) AS similarity FROM (SELECT id AS query FROM dc WHERE id % 20 = 0) q CROSS JOIN alltags LEFT JOIN sm USING (query, hashtag)), cl AS (SELECT query, hashtag FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, hashtag) AS n FROM full_sm) WHERE n = 1) "
#: The queries are the posts whose id 20 divides; all posts are fitted.
_ASKED = "id % 20 = 0"


def _walk(s, d, steps=None):
    return R.GraphWalk(steps=steps).fit(V.posts(s, d))


def _asked(s, d):
    return V.documents(s, d).where(_ASKED).select(F.col("id").alias("query"), "lemmas")


def _tag_documents(s, d):
    p = V.posts(s, d)
    return tfidf.tag_documents(p, saved(hashtags.common(p, 3), "common"))


@q("tag_documents", sql("dcf", _TF + "SELECT hashtag, token, tf FROM td"))
def _(s, d):
    return _tag_documents(s, d)


@q("tfidf_weights", sql("dcf", _TF + "SELECT hashtag, token, round(weight, 6) AS weight FROM wt"))
def _(s, d):
    return tfidf.weights(saved(_tag_documents(s, d), "documents")).select("hashtag", "token", F.round("weight", 6).alias("weight"))


@q("tfidf_similarity", sql("dcf", _CLOSE + "SELECT query, hashtag, round(similarity, 6) AS similarity FROM full_sm"))
def _(s, d):
    return _walk(s, d).similarities(_asked(s, d)).select("query", "hashtag", F.round("similarity", 6).alias("similarity"))


@q("closest_hashtag", sql("dcf", _CLOSE + "SELECT query, hashtag FROM cl"))
def _(s, d):
    w = _walk(s, d)
    return w.preference(_asked(s, d)).select("query", F.col("tag").alias("hashtag"))


_PREF = _CLOSE.rstrip() + ", qtag AS (SELECT id AS query, hashtags[1] AS tag FROM dc WHERE id % 20 = 0), pf AS (SELECT cl.query, coalesce(t.hashtag, cl.hashtag) AS tag FROM cl LEFT JOIN qtag USING (query) LEFT JOIN alltags t ON t.hashtag = qtag.tag) "


@q("preference_tags", sql("dcf", _PREF + "SELECT query, tag FROM pf"))
def _(s, d):
    w = _walk(s, d)
    asked = V.documents(s, d).where(_ASKED).select(F.col("id").alias("query"), "lemmas", F.get("hashtags", F.lit(0)).alias("tag"))
    return w.preference(asked)


def _walked(steps: int) -> str:
    out = _SHARED.rstrip() + _CLOSE.rstrip().replace("WITH td AS", ", td AS") + ", r0 AS (SELECT query, hashtag AS tag, 1e0 AS r FROM cl)"
    for n in range(1, steps + 1):
        out += f", r{n} AS (SELECT query, tag, sum(r) AS r FROM (SELECT query, j AS tag, 0.8e0 * sum(r * t) AS r FROM r{n - 1} JOIN tr ON tag = i GROUP BY 1, 2 UNION ALL SELECT query, tag, 0.2e0 FROM r0) GROUP BY 1, 2)"
    return out + " "


@q("random_walk_iter_k", sql("dcf", _walked(2) + "SELECT query, tag, round(r, 6) AS r FROM r2"))
def _(s, d):
    w = _walk(s, d)
    start = w.preference(_asked(s, d))
    return graph.walk(w.edges, start, 0.8, steps=2).select("query", "tag", F.round("r", 6).alias("r"))


_WALKRANK = _walked(2) + ", rk AS (SELECT query, hashtag, round(similarity * coalesce(r, 0), 9) AS score FROM full_sm LEFT JOIN r2 ON r2.query = full_sm.query AND r2.tag = full_sm.hashtag) "
_WALKRANK = _WALKRANK.replace("SELECT query, hashtag, round(similarity", "SELECT full_sm.query, hashtag, round(similarity")


@q("rank_graph_walk_iter_k", sql("dcf", _WALKRANK + "SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, hashtag) AS rank, hashtag FROM rk"))
def _(s, d):
    return _walk(s, d, 2).from_lemmas(_asked(s, d)).select("query", F.col("rank").cast("long").alias("rank"), "hashtag")


@q("recommend_graph_walk_iter_k", sql("dcf", _WALKRANK + "SELECT * FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, hashtag) AS rank, hashtag, round(score, 6) AS score FROM rk) WHERE rank <= 10"))
def _(s, d):
    return _walk(s, d, 2).from_lemmas(_asked(s, d), 10).select("query", F.col("rank").cast("long").alias("rank"), "hashtag", F.round("score", 6).alias("score"))


@q("rank_graph_walk")
def _(s, d):
    return _walk(s, d).from_lemmas(_asked(s, d)).select("query", F.col("rank").cast("long").alias("rank"), "hashtag")


@q("recommend_graph_walk")
def _(s, d):
    return _walk(s, d).from_lemmas(_asked(s, d), 10).select("query", F.col("rank").cast("long").alias("rank"), "hashtag", F.round("score", 6).alias("score"))


_FOUND = "WITH lk AS (SELECT id, pos, w AS word, vector FROM (SELECT id, unnest(lemmas) AS w, generate_subscripts(lemmas, 1) AS pos FROM dc) JOIN wv ON word = w) "


@q("lemma_vector_join", sql("wv", _FOUND + "SELECT id, pos - 1 AS pos, word, round(vector[1], 6) AS first FROM lk"))
def _(s, d):
    p = V.posts(s, d)
    return embed.lookup(p, V.word_vectors(s, d, p)).select("id", F.col("pos").cast("long").alias("pos"), "word", F.round(F.col("vector")[0], 6).alias("first"))


_KNOWN = "WITH kw AS (SELECT * FROM wv WHERE word < 't'), "


@q("tweet_embedding_mean", sql("wv", _KNOWN + "lk AS (SELECT id, vector FROM (SELECT id, unnest(lemmas) AS w FROM dc) JOIN kw ON word = w), mm AS (SELECT id, pos, avg(x) AS m FROM (SELECT id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM lk) GROUP BY 1, 2) SELECT dc.id, pos - 1 AS pos, round(m, 6) + 0e0 AS m FROM dc LEFT JOIN mm USING (id)"))
def _(s, d):
    p = V.posts(s, d)
    m = embed.mean_embedding(p, V.word_vectors(s, d, p, "array<float>").where("word < 't'"))
    return m.select("id", F.posexplode_outer("embedding").alias("pos", "m")).select("id", F.col("pos").cast("long").alias("pos"), (F.round("m", 6) + 0.0).alias("m"))


@q("oov_rate", sql("wv", _KNOWN + "f AS (SELECT id, unnest(lemmas) AS w FROM dc) SELECT id, round(1 - count(word) / count(*), 6) AS oov FROM f LEFT JOIN kw ON word = w GROUP BY id"))
def _(s, d):
    p = V.posts(s, d)
    return embed.unknown_share(p, V.word_vectors(s, d, p).where("word < 't'")).select("id", F.round("oov", 6).alias("oov"))


@q("filter_oov", sql("wv", _KNOWN + "f AS (SELECT id, unnest(lemmas) AS w, generate_subscripts(lemmas, 1) AS pos FROM dc) SELECT id, array_to_string(list(w ORDER BY pos), ' ') AS lemmas FROM f SEMI JOIN kw ON word = w GROUP BY id"))
def _(s, d):
    p = V.posts(s, d)
    f = embed.lookup(p, V.word_vectors(s, d, p).where("word < 't'").select("word", F.lit(None).alias("vector")))
    return f.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w")).select("id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("lemmas"))


_SIFW = "WITH wc AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(lemmas) AS w FROM dc) GROUP BY 1), ww AS (SELECT word, n, 1e0 / (1e0 + n / (SELECT sum(n) FROM wc)) AS weight FROM wc WHERE n >= 2) "


@q("sif_word_weights", sql("dc", _SIFW + "SELECT word, n, round(weight, 6) AS weight FROM ww"))
def _(s, d):
    return embed.word_weights(V.documents(s, d), least=2).select("word", F.col("count").alias("n"), F.round("weight", 6).alias("weight"))


def _sif(s, d):
    p = V.posts(s, d)
    return embed.weighted_average(p, V.word_vectors(s, d, p, "array<float>"), embed.word_weights(p, least=2))


@q("sif_weighted_average", sql("wv", _SIFW.rstrip() + _FOUND.rstrip().replace("WITH lk", ", lk") + ", wl AS (SELECT id, vector, coalesce(weight, 0) AS weight FROM lk LEFT JOIN ww USING (word)) SELECT id, pos - 1 AS pos, round(avg(x * weight), 6) + 0e0 AS m FROM (SELECT id, weight, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM wl) GROUP BY 1, 2"))
def _(s, d):
    return _sif(s, d).select("id", F.posexplode("embedding").alias("pos", "m")).select("id", F.col("pos").cast("long").alias("pos"), (F.round("m", 6) + 0.0).alias("m"))


@q("sif_principal_component")
def _(s, d):
    pc = embed.principal_direction(_sif(s, d))
    return s.createDataFrame([(i, abs(float(x))) for i, x in enumerate(pc)], "pos int, size double")


@q("sif_embedding")
def _(s, d):
    e = saved(_sif(s, d), "sif")
    return embed.without_direction(e, embed.principal_direction(e))


_NN = "WITH pt AS (SELECT vec_id AS id, v FROM emb), ds AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda t: abs(t[1] - t[2]))) AS d FROM pt a CROSS JOIN pt b), nn AS (SELECT * FROM (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS rank FROM ds) WHERE rank <= 16), ep AS (SELECT avg(d) AS epsilon FROM nn) "
_CLUSTER = _NN.replace("WITH pt", "WITH RECURSIVE pt").rstrip() + ", cp AS (SELECT a, b, d FROM ds, ep WHERE a < b AND d <= epsilon), bi AS (SELECT a, b FROM cp UNION SELECT b, a FROM cp), rc AS (SELECT id, id AS c FROM pt UNION SELECT bi.b, rc.c FROM rc JOIN bi ON bi.a = rc.id AND rc.c < bi.b), lb AS (SELECT id, min(c) AS cluster FROM rc GROUP BY id) "


def _points(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


@q("knn_l1", sql("emb", _NN + "SELECT a, rank, b, round(d, 6) AS d FROM nn"))
def _(s, d):
    return density.nearest(_points(s, d)).select("a", F.col("rank").cast("long").alias("rank"), "b", F.round("d", 6).alias("d"))


@q("dbscan_epsilon", sql("emb", _NN + "SELECT round(epsilon, 6) AS epsilon FROM ep"))
def _(s, d):
    return density.radius(_points(s, d)).select(F.round("epsilon", 6).alias("epsilon"))


@q("epsilon_pairs", sql("emb", _NN + "SELECT a, b, round(d, 6) AS d FROM ds, ep WHERE a < b AND d <= epsilon"))
def _(s, d):
    p = _points(s, d)
    return density.close_pairs(p, density.radius(p)).select("a", "b", F.round("d", 6).alias("d"))


@q("dbscan_clusters", sql("emb", _CLUSTER + "SELECT id, cluster FROM lb").replace("WITH emb", "WITH RECURSIVE emb").replace(", RECURSIVE pt", ", pt"))
def _(s, d):
    return density.clusters(_points(s, d))


@q("components", sql("emb", _CLUSTER + "SELECT id AS node, cluster AS component FROM lb").replace("WITH emb", "WITH RECURSIVE emb").replace(", RECURSIVE pt", ", pt"))
def _(s, d):
    p = _points(s, d)
    return graph.components(p.select(F.col("id").alias("node")), density.close_pairs(p, density.radius(p)))


@q("giant_component", sql("emb", _CLUSTER + "SELECT id FROM lb WHERE cluster = (SELECT cluster FROM lb GROUP BY 1 ORDER BY count(*) DESC, cluster LIMIT 1)").replace("WITH emb", "WITH RECURSIVE emb").replace(", RECURSIVE pt", ", pt"))
def _(s, d):
    c = density.clusters(_points(s, d))
    top = c.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(1)
    return c.join(F.broadcast(top), "cluster", "left_semi").select("id")


_MEDOID = _CLUSTER.rstrip() + ", cm AS (SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM lb JOIN pt USING (id)) GROUP BY 1, 2), cv AS (SELECT cluster, list(m ORDER BY pos) AS m FROM cm GROUP BY 1), md AS (SELECT cluster, id, v FROM (SELECT cluster, id, v, row_number() OVER (PARTITION BY cluster ORDER BY round(list_distance(v, m), 9), id) AS n FROM lb JOIN pt USING (id) JOIN cv USING (cluster)) WHERE n = 1), tg AS (SELECT event_id AS id, unnest([event_type, 'k' || regexp_extract(props, '\"k\": *([0-9]+)', 1)]) AS hashtag, generate_subscripts([1, 2], 1) - 1 AS pos FROM events), ct AS (SELECT cluster, hashtag, count(*) AS n, min(id * 10 + pos) AS f FROM tg JOIN lb USING (id) GROUP BY 1, 2), cr AS (SELECT cluster, hashtag, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) AS rank FROM ct) "


def _rec(body: str) -> str:
    return sql("emb", body).replace("WITH emb", "WITH RECURSIVE emb").replace(", RECURSIVE pt", ", pt")


def _tags(s, d):
    return V.events(s, d).select("id", F.posexplode("hashtags").alias("pos", "hashtag"))


@q("cluster_medoid", _rec(_MEDOID + "SELECT cluster, id FROM md"))
def _(s, d):
    p = _points(s, d)
    return density.medoids(p, density.clusters(p)).select("cluster", "id")


@q("cluster_top_tags", _rec(_MEDOID + "SELECT cluster, rank, hashtag, n FROM cr"))
def _(s, d):
    return density.cluster_tags(_tags(s, d), density.clusters(_points(s, d))).select("cluster", F.col("rank").cast("long").alias("rank"), "hashtag", F.col("count").alias("n"))


@q("cluster_profiles", _rec(_MEDOID + "SELECT md.cluster, md.id AS medoid, string_agg(hashtag, ',' ORDER BY rank) AS tags FROM md JOIN cr USING (cluster) GROUP BY 1, 2"))
def _(s, d):
    m = R.Clusters().fit(_points(s, d), _tags(s, d))
    t = m.tags.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "hashtag"))).alias("t"))
    return m.medoids.join(t, "cluster").select("cluster", F.col("id").alias("medoid"), F.array_join(F.transform("t", lambda x: x["hashtag"]), ",").alias("tags"))


_CRANK = _MEDOID.rstrip() + ", qd AS (SELECT q.id AS query, cluster, round(1 - list_inner_product(q.v, md.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(md.v, md.v))), 9) AS d FROM pt q CROSS JOIN md WHERE q.id % 20 = 0), qc AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, cluster) AS c FROM qd), qr AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY c, rank) AS rank, hashtag FROM qc JOIN cr USING (cluster)) "


@q("rank_clusters", _rec(_CRANK + "SELECT * FROM qr"))
def _(s, d):
    p = _points(s, d)
    return R.Clusters().fit(p, _tags(s, d)).from_embeddings(p.where("id % 20 = 0").withColumnRenamed("id", "query")).select("query", F.col("rank").cast("long").alias("rank"), "hashtag")


@q("recommend_clusters", _rec(_CRANK + "SELECT * FROM qr WHERE rank <= 10"))
def _(s, d):
    p = _points(s, d)
    return R.Clusters().fit(p, _tags(s, d)).from_embeddings(p.where("id % 20 = 0").withColumnRenamed("id", "query"), 10).select("query", F.col("rank").cast("long").alias("rank"), "hashtag")


@q("char_classifier")
def _(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("query"), "text", F.col("lang").alias("hashtag"))
    model = R.Characters(classes=8)
    docs = saved(model.features(docs), "features")
    return model.fit(docs).transform(docs.select("query", "features"), 3)
