"""Operators that must not make rows for every pair, step or vector: results against brute force, and what they shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import density, embed, graph, tfidf
from tagweave.plans import evaluate
from tagweave.plans.recommend import Popularity
from tagweave.sources import records


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_walk_makes_no_rows_of_starts_and_arcs(spark):
    """One user has all tags: each walk reaches all of them at once. Some posts share a pair of tags, some have one."""
    n = 60
    posts = [(i, "u" if i < n else f"v{i % 5}", sorted({f"t{i % n}", f"t{i * 7 % n}"})) for i in range(150)]
    edges = graph.tripartite(spark.createDataFrame(posts, "id long, username string, hashtags array<string>"))
    tags = sorted({t for *_, ts in posts for t in ts})
    near = {t: {("u", u) for _, u, ts in posts if t in ts} | {("p", i) for i, _, ts in posts if t in ts} for t in tags}
    w = np.array([[len(near[a] & near[b]) * (a != b) for b in tags] for a in tags], float)
    step = w / (w.sum(0) + 1e-8)
    shared, moved = graph.shared_neighbours(edges), graph.transitions(edges)
    assert "Exchange" not in _plan(shared) + _plan(moved)
    at = {t: i for i, t in enumerate(tags)}
    for rows, want in ((shared, w), (moved, step)):
        got = np.zeros_like(w)
        for r in rows.collect():
            got[at[r["i"]], at[r["j"]]] = r[2]
        assert np.allclose(got, want, atol=1e-15) and rows.count() == (w > 0).sum()
    start = spark.createDataFrame([(q, tags[q % 50]) for q in range(70)], "query int, tag string")
    walked = graph.walk(edges, start, steps=2)
    assert "Join" not in _plan(walked)
    got = {(r["query"], r["tag"]): r["r"] for r in walked.collect()}
    for q in range(70):
        p = np.eye(len(tags))[q % 50]
        r = 0.8 * (0.8 * p @ step + 0.2 * p) @ step + 0.2 * p
        assert [got.get((q, t), 0.0) for t in tags] == pytest.approx(r.tolist(), abs=1e-12)


@pytest.mark.parametrize("pairs", [7, 1 << 21])
def test_tiles_are_the_product(spark, monkeypatch, pairs):
    monkeypatch.setattr(tfidf, "TILE", 16)
    monkeypatch.setattr(tfidf, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    x, y = rng.random((30, 40)) * (rng.random((30, 40)) < 0.2), rng.random((50, 40)) * (rng.random((50, 40)) < 0.1)
    x[:, 3], y[:, 3], x[4] = 0.5, 0.25, 0
    rows = lambda m, name: spark.createDataFrame([(name[0] + f"{i:02}", f"w{k}", float(m[i, k])) for i, k in np.argwhere(m)], f"{name} string, token string, weight double")
    names = np.array([f"h{i:02}" for i in range(50)], object)
    numbers = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "hashtag string, t int")
    queries = spark.createDataFrame([(f"q{i:02}",) for i in range(30)], "query string")
    tiles = tfidf.Tiles(queries, rows(x, "query"), rows(y, "hashtag"), names, numbers)
    want = x @ y.T
    got = {(r["query"], r["hashtag"]): r["similarity"] for r in tiles.rows().collect()}
    assert len(got) == want.size
    assert np.allclose([[got[f"q{i:02}", t] for t in names] for i in range(30)], want, atol=1e-12)
    best = tiles.vectors(whole=False).groupBy("query").agg(F.min_by("hashtag", F.struct(-F.col("best"), "hashtag")).alias("t"))
    assert {r["query"]: r["t"] for r in best.collect()} == {f"q{i:02}": names[np.round(want[i], 9).argmax()] for i in range(30)}
    for r in tiles.vectors().collect():
        assert np.allclose(r["values"], want[int(r["query"][1:]), r["low"] : r["low"] + 16], atol=1e-12)


def test_means_carry_a_vector_once_a_block(spark, monkeypatch):
    """Posts of few words, repeated: blocks of posts, repeated ids, words without weight, without vector, posts without words."""
    monkeypatch.setattr(embed, "TOKENS", 64)
    rng = np.random.default_rng(6)
    v = {f"w{i}": rng.normal(size=3).tolist() for i in range(12)}
    posts = [(i % 55, [None if x == 13 else f"W{x}" if x % 2 else f"w{x}" for x in rng.integers(0, 15, rng.integers(0, 20))]) for i in range(60)] + [(90, None), (91, [])]
    df = spark.createDataFrame(posts, "id long, lemmas array<string>")
    vectors = spark.createDataFrame(list(v.items()), "word string, vector array<double>")
    weights = spark.createDataFrame([(f"w{i}", 1.0 / (1 + i)) for i in range(8)], "word string, weight double")
    found = {i: [x.lower() for j, ws in posts if j == i for x in ws or [] if x and x.lower() in v] for i, _ in posts}
    made = embed.weighted_average(df, vectors, weights)
    assert "Summarizer" not in _plan(made) and "summarizer" not in _plan(made)
    got = {r["id"]: r["embedding"] for r in made.collect()}
    assert set(got) == {i for i in found if found[i]}
    for i in got:
        assert got[i] == pytest.approx(np.mean([np.array(v[x]) * (1 / (1 + int(x[1:])) if int(x[1:]) < 8 else 0) for x in found[i]], 0).tolist())
    means = {r["id"]: r["embedding"] for r in embed.mean_embedding(df.dropDuplicates(["id"]), vectors).collect()}
    assert means[90] is None and means[91] is None and len(means) == 57


def test_nearest_computes_a_pair_of_blocks_once(spark, monkeypatch):
    """Many equal distances and copies, over several blocks; each distance is computed for both of its points at once."""
    monkeypatch.setattr(density, "BLOCK", 60)
    monkeypatch.setattr(density, "SLICE", 17)
    rng = np.random.default_rng(8)
    v = rng.integers(0, 4, (230, 3)).astype(float)
    points = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    halves, compared = [], density._compared
    monkeypatch.setattr(density, "_compared", lambda *a, **b: halves.append(b.get("half")) or compared(*a, **b))
    got = {(r["a"], r["rank"]): (r["b"], r["d"]) for r in density.nearest(points, 5).collect()}
    far = np.abs(v[:, None] - v[None]).sum(-1)
    order = np.argsort(far, axis=1, kind="stable")[:, :5]
    assert got == {(a * 3, n + 1): (b * 3, far[a, b]) for a, near in enumerate(order.tolist()) for n, b in enumerate(near)}
    assert halves == [True]


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e12])
def test_few_pairs_are_computed_in_double_precision(monkeypatch, scale):
    """The integer steps keep every pair within the reach, ties at it too, and leave few others; infinite values keep all."""
    monkeypatch.setattr(density, "SLICE", 100)
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(330, 64)) * scale, rng.normal(size=(270, 64)) * scale
    y[5], y[6] = x[7], x[8]
    far = np.zeros((330, 270))
    for i in range(64):
        far += np.abs(x[:, i, None] - y[:, i])
    left, right = np.sort(far, 1)[:, 2], np.full(270, -1.0)
    right[9] = far[:, 9].min()
    a, b, d = (np.concatenate(c) for c in zip(*density._within(x, y, left, right), strict=True))
    assert np.array_equal(d, far[a, b]) and len(a) < far.size / 20
    wanted = (far <= left[:, None]) | (far <= right)
    assert set(zip(*np.nonzero(wanted), strict=True)) <= set(zip(a, b, strict=True)) and wanted.sum() >= 990
    x[0, 0] = np.inf
    assert sum(len(a) for a, *_ in density._within(x, y, left, right)) == far.size


def test_ranks_and_grid_shuffle_no_posts(spark):
    """Ranks over posts and their tags against the general form: rare tags, a tag opposite to its posts, posts without tags."""
    rng = np.random.default_rng(12)
    posts = [(i, [f"t{x}" for x in rng.integers(0, 9, rng.integers(0, 4))], rng.normal(size=4).tolist(), int(rng.integers(0, 5))) for i in range(120)]
    posts += [(200, ["up"], [1.0, 0.0, 0.0, 0.0], 1), (201, ["up"], [1.0, 0.0, 0.0, 0.0], 2), (202, ["up"], [-1.0, 0.0, 0.0, 0.0], 3), (203, None, [1.0, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(posts, "id long, hashtags array<string>, embedding array<double>, retweet_count long")
    tags = graph.profile(df)
    want = {r["node"]: r["x"] for r in graph.pagerank(*graph.rank_graph(df, tags), steps=3).collect()}
    ranks = graph.Ranks(df, tags).run(steps=3)
    got = {r["node"]: r["x"] for r in ranks.nodes().collect()}
    assert set(got) == set(want) and got == pytest.approx(want, abs=1e-12)
    assert "Exchange" not in _plan(ranks.nodes())
    test = df.where("id % 2 = 0 and size(hashtags) > 0").select(F.col("id").alias("query"), F.col("hashtags").alias("truth"), "embedding", "retweet_count")
    counts = df.select(F.explode("hashtags").alias("hashtag")).groupBy("hashtag").agg(F.count("*").alias("count"))
    grid = evaluate.grid_search(test, tags.join(counts, "hashtag"), ["mean_retweets"], [100, 9], [0.4], [1, 3], spark.range(1).selectExpr("200L"))
    plan = _plan(grid)
    assert "Window" not in plan and "Join" not in plan
    got = {(r["dataset"], r["least"], r["k"]): (r["recall"], r["n"]) for r in grid.collect()}
    for least in (100, 9):
        kept = counts.where(F.col("count") >= 200 // least).select("hashtag")
        model = Popularity(0.4)
        model.profile = tags.join(kept, "hashtag")
        for k in (1, 3):
            rows = evaluate.evaluate(test, lambda asked: model.from_embeddings(asked, 10), k)  # noqa: B023
            part = F.when(F.col("retweet_count") > 0, "popular").otherwise("unpopular")
            for r in evaluate.means(rows.withColumn("dataset", part), ["recall"], ["dataset"]).collect():
                assert got[r["dataset"], least, k] == (r["recall"], r["n"])


def test_fit_carries_no_vector_through_a_join_of_posts(spark):
    posts = spark.createDataFrame([(i, [f"t{i % 3}", "rare" if i == 5 else "all"], [1.0, float(i)], i) for i in range(30)] + [(99, ["all"], None, 7)], "id long, hashtags array<string>, embedding array<double>, retweet_count long")
    profile = {r["hashtag"]: r["mean_retweets"] for r in Popularity(least=2).fit(posts).profile.collect()}
    assert profile == {"t0": 13.5, "t1": 14.5, "t2": 15.5, "all": pytest.approx((435 - 5) / 29)}
    assert "SortMergeJoin" not in _plan(graph.profile(posts)) and "BroadcastHashJoin" not in _plan(graph.profile(posts))


def test_tagged_lines_are_not_shuffled(spark):
    text = "0\tAla\t_\tALA:s1\tsubst\n1\t.\t_\t.\t interp \n2\tAla\t_\tother\tsubst\n3\tkot\t_\tKot\tsubst\textra\nshort\tline"
    made = records.parse_tagged(spark.createDataFrame([("f", text), ("g", None), ("h", "")], "file string, value string"))
    assert {r["file"]: r["lemmas"] for r in made.collect()} == {"f": ["ala", "kot"], "g": [], "h": []}
    assert "Exchange" not in _plan(made)


def test_lemmas_are_counted_where_their_posts_lie(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "COUNTED", 40)
    posts = [(["a", "b"], ["Xx", "yy", "xx", "z"]), (["a"], ["xx", "ww"]), (["c"], ["yy"]), ([], ["vv"]), (["b"], None)] * 9
    df, common = spark.createDataFrame(posts, "hashtags array<string>, lemmas array<string>"), spark.createDataFrame([("a",), ("b",)], "hashtag string")
    made = tfidf.tag_documents(df, common)
    assert _plan(made).count("Exchange") == 1 + _plan(made).count("BroadcastExchange")
    assert {(r["hashtag"], r["token"]): r["tf"] for r in made.collect()} == {("a", "xx"): 27, ("a", "yy"): 9, ("a", "ww"): 9, ("b", "xx"): 18, ("b", "yy"): 9}
    weighed = tfidf.weights(made)
    assert "Window" not in _plan(weighed) and "SortMergeJoin" not in _plan(weighed)
    lengths = weighed.groupBy("hashtag").agg(F.sum(F.col("weight") * F.col("weight")).alias("x")).collect()
    assert [r["x"] for r in lengths] == pytest.approx([1.0, 1.0])


def test_records_of_a_file_are_parsed_in_parts(spark, tmp_path):
    """Whatever parts a file is read in: records across their edges, numbers, multi-line fields and dropped files stay the same."""
    good = "".join(f"Type:status\nText:t{i}\n\nmore: of it\nID:{i}\nHashtags:a b\n *** \n" for i in range(30))
    files = {"good": good + "Text:never closed\n", "bad": good + "ID:1\nstray\nHashtags:a\n***\n", "early": "stray\nHashtags:a\n***\n" + good, "open": "Text:no mark\n"}
    for name, text in files.items():
        (tmp_path / f"{name}.txt").write_text(text)
    whole = spark.createDataFrame(list(files.items()), "file string, value string")
    expected = sorted(map(repr, records.parse_records(whole).collect()))
    assert len(expected) == 61 and not [r for r in expected if "'bad'" in r]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("40", "300"):
            for key, value in zip(before, (size, "0"), strict=True):
                spark.conf.set(key, value)
            lines = records.read_lines(spark, str(tmp_path)).withColumn("file", F.regexp_extract("file", r"([^/]+)\.txt", 1))
            assert lines.select("file", "at").distinct().count() > 10
            assert sorted(map(repr, records.parse_records(lines).collect())) == expected
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_no_row_of_the_records_view_is_a_file(spark, tmp_path):
    from tagweave.plans import files

    spark.range(4 * 97).selectExpr("id AS event_id", "'view' AS event_type", "'p' AS props").write.parquet(str(tmp_path / "events.parquet"))
    pieces = files._record_texts(spark, str(tmp_path))
    assert pieces.groupBy("file").count().where("count = 4").count() == 97
    assert pieces.select("file", F.spark_partition_id()).distinct().count() == 97


def test_trigrams_are_counted_in_one_pass_as_mllib_counts_them(spark):
    """The features are MLlib's, of characters of any width and of texts longer than a slice; no array of strings is made."""
    from pyspark.ml.feature import HashingTF, NGram

    from tagweave.plans.recommend import Characters

    texts = ["", "a", "ab", "abc", "Ab\n c\t", "żółć ĄĘ", "日本語テキスト", "😀😁x😂🤣", "İẞǅ ÿÿÿ", "x😀y日zé" * 20000, *(f"text {i} of many " * (i % 7) for i in range(50))]
    posts = spark.createDataFrame(list(enumerate(texts)), "query long, text string")
    chars = posts.withColumn("chars", F.split(F.lower("text"), ""))
    for size in (4096, 1000):
        expected = HashingTF(numFeatures=size, inputCol="grams", outputCol="features").transform(NGram(n=3, inputCol="chars", outputCol="grams").transform(chars))
        made = Characters(size).features(posts)
        assert {r["query"]: r["features"] for r in made.collect()} == {r["query"]: r["features"] for r in expected.select("query", "features").collect()}
    assert "NGram" not in _plan(made) and "split" not in _plan(made)
    odd = spark.sql("SELECT 1L AS query, CAST(unhex('61ff62') AS STRING) AS text UNION ALL SELECT 2L, CAST(NULL AS STRING)")
    assert {r["query"]: r["features"].numNonzeros() for r in Characters().features(odd).collect()} == {1: 1, 2: 0}


def test_classifier_takes_texts_or_their_saved_features(spark):
    from tagweave.plans.recommend import Characters
    from tagweave.sources.store import saved

    rows = [(i, f"{w} {w} {i}", t) for i in range(40) for w, t in [(("alpha", "a"), ("beta", "b"), ("gamma", "c"))[i % 3]]]
    posts = spark.createDataFrame([*rows, (40, None, "a"), (41, "alpha", None)], "query long, text string, hashtag string")
    model = Characters(64)
    features = saved(model.features(posts), "features")
    assert features.columns == ["query", "hashtag", "features"]
    plain = Characters(64).fit(posts).transform(posts.select("query", "text"), 1).collect()
    got = model.fit(features).transform(features.select("query", "features"), 1).collect()
    assert sorted(got) == sorted(plain) and len(got) == 42
    assert all(r["hashtag"] == "abc"[r["query"] % 3] for r in got if r["query"] < 40)
