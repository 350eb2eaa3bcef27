"""Hand-computed cases for the library's operators."""

import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from tagweave.functions import metrics as M
from tagweave.functions import vectors as X
from tagweave.operators import density, embed, graph, hashtags, tfidf
from tagweave.operators.order import in_order, quantile_marks
from tagweave.plans.recommend import Popularity, random_tags
from tagweave.sources import records

POSTS = [(1, "u", 4, ["a", "a", "b"], [1.0, 0.0]), (2, "v", 0, ["a", "c"], [0.0, 1.0]), (3, "w", 2, ["b"], [1.0, 1.0])]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(POSTS, "id long, username string, retweet_count long, hashtags array<string>, embedding array<double>")


def test_metrics(spark):
    rows = [(["a", "b", "b"], ["a", "c", "b"], 2, 1 / 3, 0.5, 0.4), (["a", "b", "b"], ["a", "c", "b"], 5, 2 / 3, 2 / 3, 2 / 3), ([], ["a"], 5, 1, 1, 1), (["x"], ["a"], 5, 0, 0, 0)]
    for truth, predicted, k, r, p, f in rows:
        df = spark.createDataFrame([(truth, predicted)], "t array<string>, p array<string>")
        t, q = F.col("t"), F.col("p")
        got = df.select(M.recall(t, q, k), M.precision(t, q, k), M.f1(t, q, k)).first()
        assert [round(x, 6) for x in got] == [round(x, 6) for x in (r, p, f)]
    df = spark.createDataFrame([(["a", "c", "g"], ["a", "b", "c"])], "t array<string>, p array<string>")
    got = df.select(M.average_precision(F.col("t"), F.col("p"), 3), M.ndcg(F.col("t"), F.col("p"), 3)).first()
    assert [round(x, 6) for x in got] == [0.555556, 0.703918]


def test_rare_filter(posts):
    kept = lambda n: {r["id"]: r["hashtags"] for r in hashtags.rare_filter(posts, n).collect()}
    assert kept(2) == {1: ["a", "a", "b"], 2: ["a"], 3: ["b"]}
    assert kept(3) == {1: ["a", "a"], 2: ["a"]}
    counts = {r["hashtag"]: r["count"] for r in hashtags.occurrences(posts).collect()}
    assert counts == {"a": 2, "b": 2, "c": 1}


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "x array<double>, y array<double>")
    assert [round(r[0], 6) for r in df.select(X.angular_similarity(F.col("x"), F.col("y"))).collect()] == [0.75, 0.0, 0.5]


def test_profile_rank_and_edges(posts):
    p = hashtags.rare_filter(posts, 2)
    tags = graph.profile(p)
    got = {r["hashtag"]: (r["embedding"], r["mean_retweets"]) for r in tags.collect()}
    assert got == {"a": ([0.5, 0.5], 2.0), "b": ([1.0, 0.5], 3.0)}
    edges = {(r["id"], r["hashtag"]): round(r["similarity"], 6) for r in graph.weighted(p, tags).collect()}
    assert edges == {(1, "a"): 0.75, (1, "b"): 0.852416, (2, "a"): 0.75, (3, "b"): 0.897584}
    arcs, nodes = graph.rank_graph(p, tags)
    rank = {r["node"]: round(r["x"], 6) for r in graph.pagerank(arcs, nodes, steps=2).collect()}
    assert rank == {"p1": 0.288248, "p2": 0.127394, "p3": 0.158014, "ta": 0.193752, "tb": 0.232592}


def test_walk(spark):
    posts = spark.createDataFrame([(1, "u", ["a", "b"]), (2, "v", ["b", "c"])], "id long, username string, hashtags array<string>")
    matrix = graph.transition(graph.shared_neighbours(graph.tripartite(posts)))
    got = {(r["i"], r["j"]): round(r["t"], 6) for r in matrix.collect()}
    assert got == {("a", "b"): 0.5, ("b", "a"): 1.0, ("b", "c"): 1.0, ("c", "b"): 0.5}
    start = spark.createDataFrame([(0, "a")], "query long, tag string")
    edges = graph.tripartite(posts)
    r = {x["tag"]: round(x["r"], 6) for x in graph.walk(edges, start, steps=2).collect()}
    assert r == {"a": 0.52, "b": 0.08, "c": 0.32}
    assert {x["tag"]: (x["degree"], x["own"]) for x in graph.weighted_degrees(edges).collect()} == {"a": (2, 2), "b": (4, 4), "c": (2, 2)}


def test_converged_walk_is_that_of_the_matrix(spark):
    """Until it settles, from two starts that three queries have, against dense matrix steps."""
    rng = np.random.default_rng(1)
    posts = [(i, f"u{i % 4}", [f"t{x}" for x in sorted(set(rng.integers(0, 9, 3).tolist()))]) for i in range(25)]
    edges = graph.tripartite(spark.createDataFrame(posts, "id long, username string, hashtags array<string>"))
    tags = sorted({t for *_, ts in posts for t in ts})
    near = {t: {("u", u) for _, u, ts in posts if t in ts} | {("p", i) for i, _, ts in posts if t in ts} for t in tags}
    w = np.array([[len(near[a] & near[b]) * (a != b) for b in tags] for a in tags], float)
    step = w / (w.sum(0) + 1e-8)
    start = spark.createDataFrame([(0, tags[0]), (1, tags[3]), (2, tags[0])], "query long, tag string")
    got = {(r["query"], r["tag"]): r["r"] for r in graph.walk(edges, start, threshold=1e-9).collect()}
    for query, first in ((0, 0), (1, 3), (2, 0)):
        p = np.eye(len(tags))[first]
        r = p
        for _ in range(200):
            r = 0.8 * r @ step + 0.2 * p
        assert all(math.isclose(got.get((query, t), 0.0), x, abs_tol=1e-7) for t, x in zip(tags, r, strict=True))


def test_numbers_and_quantiles_in_ranges(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double").repartition(7)
    want = {i: n + 1 for n, i in enumerate(np.lexsort((np.arange(500), x)).tolist())}
    assert {r["id"]: r["n"] for r in in_order(df, "x", "id").collect()} == want
    marks = {r["share"]: r["mark"] for r in quantile_marks(df, "x", [0.0, 0.1, 0.33, 0.5, 1.0], "id").collect()}
    assert all(math.isclose(marks[s], np.quantile(x, s), abs_tol=1e-9) for s in marks) and len(marks) == 5


def test_estimators_save_and_load(spark, posts, tmp_path):
    from tagweave import ml

    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.3, 0.9])], "query long, embedding array<double>")
    model = ml.PopularityRecommender(ratio=0.4, least=1, k=2).fit(posts)
    want = [tuple(r) for r in Popularity(0.4, least=1).fit(posts).from_embeddings(asked, 2).orderBy("query", "rank").collect()]
    assert [tuple(r) for r in model.transform(asked).orderBy("query", "rank").collect()] == want
    model.save(str(tmp_path / "m"))
    back = ml.PopularityModel.load(str(tmp_path / "m"), spark)
    assert back.getOrDefault("k") == 2 and [tuple(r) for r in back.transform(asked).orderBy("query", "rank").collect()] == want
    texts = posts.withColumn("lemmas", F.array(F.lit("some"), F.concat(F.lit("word"), "id")))
    walk = ml.GraphWalkRecommender(least=1, k=1).fit(texts).transform(texts.select(F.col("id").alias("query"), "lemmas"))
    assert walk.groupBy("query").count().where("count = 1").count() == texts.count()
    near = ml.ClustersRecommender(neighbours=2).fit(posts.where("embedding is not null")).transform(asked)
    assert near.where("query = 0").count() > 0


def test_command_line(spark, posts, tmp_path, capsys):
    from tagweave.__main__ import main

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.txt").write_text("Type:status\nOrigin:x\nID:1\nHashtags:a b\n***\nID:2\nHashtags:\n***\n")
    main(["parse", str(tmp_path / "in"), str(tmp_path / "out"), "--merge"])
    assert [r["ID"] for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == ["1"]
    (tmp_path / "v.txt").write_text("one 1.0 2.0\ntwo 3.0 4.5\n")
    main(["vectors", str(tmp_path / "v.txt"), str(tmp_path / "v")])
    assert {r["word"]: r["vector"] for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {"one": [1.0, 2.0], "two": [3.0, 4.5]}
    posts.write.parquet(str(tmp_path / "posts"))
    spark.createDataFrame([(0, [1.0, 0.0])], "query long, embedding array<double>").write.parquet(str(tmp_path / "asked"))
    main(["recommend", str(tmp_path / "posts"), str(tmp_path / "asked"), str(tmp_path / "ranked"), "--least", "1", "-k", "2"])
    assert spark.read.parquet(str(tmp_path / "ranked")).count() == 2
    main(["time", str(tmp_path / "posts"), str(tmp_path / "asked"), "--least", "1", "--runs", "2"])
    assert "2 runs" in capsys.readouterr().out


def test_users_names_and_plans(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "anna b.csv").write_text("ID,text\n1,x\n2,y\n")
    got = records.read_csv_of_users(spark, str(tmp_path / "u"), "ID long, text string", "ID").collect()
    assert sorted((r["ID"], r["username"]) for r in got) == [(1, "anna b"), (2, "anna b")]
    assert records.scraping_plan("a:\n - x\n - 'y'\nb:\n") == {"a": ["x", "y"], "b": []}


def test_entities_equal_plain_patterns(spark):
    import re

    from tagweave.functions import text as T

    texts = ["RT @anna: see https://a.b/c?d=1 #tag1 :-) 12,5 costs 3.4% x7 \U0001f600", "no", "", "#a#b @c 1 2 3 -4 +5.5 FAV :D http://x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = {r["id"]: (r["a"], r["b"]) for r in df.select("id", T.tokenise_entities(F.col("text")).alias("a"), T.clean_entities(F.col("text")).alias("b")).collect()}
    for i, t in enumerate(texts):
        a = b = t
        for kind, pattern in T.ENTITIES.items():
            plain = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern)
            a, b = re.sub(plain, f"${kind}$", a, flags=re.ASCII), re.sub(plain, "", b, flags=re.ASCII)
        assert rows[i] == (a, re.sub(r"\s+", " ", b).strip())


def test_latest_versions_as_stream(spark, tmp_path):
    from tagweave.streaming.tags import keep_latest

    kind = "id long, at long, n long, text string"
    rows = [(1, 5, 0, "old"), (2, 1, 1, "two"), (1, 9, 2, "new"), (1, 9, 3, "later arrival")]
    seen = []
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = keep_latest(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "id", "at", "n", lambda r, e: seen.append(sorted(tuple(x) for x in r.select("id", "text").collect())), str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()
    assert seen == [[(1, "old"), (2, "two")], [(1, "new")]]


def test_tfidf(spark):
    posts = spark.createDataFrame([(1, ["a"], ["kot", "pies"]), (2, ["b"], ["kot", "kot"]), (3, ["c"], ["dom"])], "id long, hashtags array<string>, lemmas array<string>")
    docs = tfidf.tag_documents(posts)
    got = {(r["hashtag"], r["token"]): round(r["weight"], 6) for r in tfidf.weights(docs).collect()}
    assert got == {("a", "kot"): 0.605349, ("a", "pies"): 0.795961, ("b", "kot"): 1.0, ("c", "dom"): 1.0}
    asked = tfidf.query_weights(spark.createDataFrame([(0, ["kot", "i"])], "query long, lemmas array<string>"), tfidf.idf(docs))
    near = {r["hashtag"]: round(r["similarity"], 6) for r in tfidf.similarity(asked, tfidf.weights(docs)).collect()}
    assert near == {"a": 0.605349, "b": 1.0}


def test_weighted_average(spark):
    posts = spark.createDataFrame([(1, ["kot", "pies"]), (2, ["kot"])], "id long, lemmas array<string>")
    vectors = spark.createDataFrame([("kot", [1.0, 0.0]), ("pies", [0.0, 1.0])], "word string, vector array<double>")
    weights = embed.word_weights(posts)
    assert {r["word"]: round(r["weight"], 6) for r in weights.collect()} == {"kot": 0.6, "pies": 0.75}
    got = {r["id"]: [round(x, 6) for x in r["embedding"]] for r in embed.weighted_average(posts, vectors, weights).collect()}
    assert got == {1: [0.3, 0.375], 2: [0.6, 0.0]}


def test_density(spark):
    points = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [2.0]), (3, [10.0])], "id long, embedding array<double>")
    assert density.radius(points, 2).first()["epsilon"] == 1.375
    labels = density.clusters(points, 2)
    assert {r["id"]: r["cluster"] for r in labels.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    assert {r["cluster"]: r["id"] for r in density.medoids(points, labels).collect()} == {0: 1, 3: 3}


def test_records(spark):
    text = "***\nType:status\nOrigin:Hello #a\nsecond line\nText:hello\nURL:http://t.co/x\nID:1\nRetCount:3\nFavorite:false\nMentionedEntities:\nHashtags:a b\n***\nType:status\nID:2\nHashtags:\n***\nID:3\nHashtags:z\n"
    texts = spark.createDataFrame([("f", text)], "file string, value string")
    (r,) = records.parse_records(texts, 1).collect()
    assert (r["ID"], r["Origin"], r["URL"], r["RetCount"], r["Favorite"], r["MentionedEntities"], r["Hashtags"]) == ("1", "Hello #a\nsecond line\n", "http://t.co/x", 3, True, [], ["a", "b"])
    assert records.parse_records(texts, 0, strict_compat=True).count() == 0


def test_tagged_and_latest(spark):
    rows = ["0\tWiozę\t_\twieźć:v\tfin", "0\t,\t_\t,\tinterp", "0\tszwagra\t_\tSzwagier:s1\tsubst", "0\tszwagra\t_\tinny\tsubst"]
    got = records.parse_tagged(spark.createDataFrame([("f", "\n".join(rows)), ("g", "broken")], "file string, value string")).collect()
    assert {r["file"]: r["lemmas"] for r in got} == {"f": ["wieźć", "szwagier"], "g": []}
    seen = spark.createDataFrame([(1, 10, 1, 0), (1, 12, 5, 1), (1, 12, 9, 2)], "id long, time long, likes long, n long")
    assert [r["likes"] for r in records.latest(seen, "id", "time", "n").collect()] == [5]


def test_bins_and_cooccurrence(spark):
    users = spark.createDataFrame([(f"u{i}", float(i)) for i in range(1, 9)], "username string, popularity double")
    assert {r["username"]: r["bin"] for r in hashtags.popularity_bins(users).collect()} == {f"u{i}": i - 1 if i > 1 else 0 for i in range(1, 9)}
    posts = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"])], "id long, hashtags array<string>")
    assert {(r["tag"], r["other"]) for r in hashtags.cooccurrence(posts).collect()} == {("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")}


def test_ratio_ends_and_rank_sum(spark, posts):
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "query long, embedding array<double>")
    rank = lambda ratio: [r["hashtag"] for r in Popularity(ratio, least=1).fit(posts).from_embeddings(asked).where("query = 0").orderBy("rank").collect()]
    assert rank(0.0)[0] == "b" and sorted(rank(1.0)) == ["a", "b", "c"] and rank(1.0)[0] == "b"
    arcs, nodes = graph.rank_graph(posts, graph.profile(posts))
    assert math.isclose(graph.pagerank(arcs, nodes).agg(F.sum("x")).first()[0], 1.0, abs_tol=1e-6)


def test_random_tags_repeat(spark):
    queries, tags = spark.range(5).toDF("query"), spark.createDataFrame([("a",), ("b",), ("c",)], "hashtag string")
    one, two = (sorted(map(tuple, random_tags(queries, tags, 4, 1337).collect())) for _ in range(2))
    assert one == two and len(one) == 20


def test_streaming_latest(spark, tmp_path):
    from tagweave.streaming.tags import tag_counts

    spark.createDataFrame([(1, "2024-01-01 00:01:00", ["a", "b"]), (2, "2024-01-01 00:02:00", ["a"])], "id long, ts string, hashtags array<string>").selectExpr("id", "to_timestamp(ts) as ts", "hashtags").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, hashtags array<string>").parquet(str(tmp_path / "in"))
    q = tag_counts(stream, "ts", "5 minutes", "10 minutes").writeStream.format("memory").queryName("tagged").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["hashtag"], r["n"]) for r in spark.table("tagged").collect()} == {("a", 2), ("b", 1)}
