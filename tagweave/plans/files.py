"""Registered queries: files written and read again, snapshots, streams, and small shapes of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.operators import embed
from tagweave.operators.order import in_order
from tagweave.plans import views as V
from tagweave.plans.registry import register as q
from tagweave.plans.views import sql, table
from tagweave.sources import records as S
from tagweave.sources.store import computed_once, newest, shared_folder
from tagweave.streaming import tags as T


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@q("csv_scan", "SELECT event_id, user_id, event_type, value, props FROM events")
def _(s, d):
    path = _folder(s, "csv")
    table(s, d, "events").select("event_id", "user_id", "event_type", "value", "props").write.option("header", True).option("escape", '"').csv(path)
    return S.read_csv(s, path, "event_id long, user_id long, event_type string, value double, props string")


def _users(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "users")
    e = table(s, d, "events").select(F.col("event_id").alias("ID"), "event_type", F.concat(F.lit("u"), F.col("user_id") % 20).alias("user"))
    e.repartition("user").write.partitionBy("user").option("header", True).csv(path)
    return S.read_csv_of_users(s, path, "ID long, event_type string", "ID")


@q("csv_column_of_files", "SELECT event_id AS ID, 'u' || user_id % 20 AS username FROM events")
def _(s, d):
    return _users(s, d)


@q("join_user_files", sql("ev", "SELECT id, retweet_count, 'u' || CAST(substr(username, 2) AS BIGINT) % 20 AS of FROM ev"))
def _(s, d):
    return V.events(s, d).select("id", "retweet_count").join(_users(s, d).select(F.col("ID").alias("id"), F.col("username").alias("of")), "id")


_RECORD = "SELECT 'f' || event_id % 97 AS file, CAST(event_id AS VARCHAR) AS id, event_type || chr(10) || 'more' || chr(10) AS origin, trim(props) AS text, 3 AS retweets, 'a b' AS tags FROM events"


def _record_texts(s: SparkSession, d: str) -> DataFrame:
    """The texts of 97 files in pieces of one record, in their order; each file lies in one partition and is not held whole."""
    shown = F.concat(F.lit("Type:status\nOrigin:"), "event_type", F.lit("\nmore\nText:"), "props", F.lit("\nID:"), "event_id", F.lit("\nRetCount:3\nHashtags:a b\n***"))
    e = table(s, d, "events").select(F.concat(F.lit("f"), F.col("event_id") % 97).alias("file"), F.lit(0).cast("long").alias("at"), shown.alias("value"), (F.col("event_id") % 97).cast("int").alias("_n"))
    return e.where("value is not null").repartitionById(97, "_n").drop("_n").sortWithinPartitions("file", "value")


def _flat_records(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.col("ID").alias("id"), F.col("Origin").alias("origin"), F.col("Text").alias("text"), F.col("RetCount").alias("retweets"), F.array_join("Hashtags", " ").alias("tags"))


@q("parse_records", _RECORD)
def _(s, d):
    return _flat_records(S.parse_records(_record_texts(s, d), 1))


@q("parse_directory", _RECORD)
def _(s, d):
    """Texts below a folder are found, parsed, saved as compressed CSV a file each, and read again."""
    source, target = _folder(s, "texts"), _folder(s, "parsed")
    _record_texts(s, d).select("file", "value").write.partitionBy("file").text(source)
    found = S.read_lines(s, source).withColumn("file", F.regexp_extract("file", "file=([^/]+)", 1))
    S.save_per_file(S.parse_records(found, 1), target)
    back = s.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(target)
    return back.select("file", F.col("ID").alias("id"), F.col("Origin").alias("origin"), F.col("Text").alias("text"), F.col("RetCount").cast("int").alias("retweets"), F.col("Hashtags").alias("tags"))


@q("parse_tagged", r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS toks FROM documents), f AS (SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM t),
 g AS (SELECT doc_id, w, min(pos) AS pos FROM f GROUP BY 1, 2) SELECT CAST(doc_id AS VARCHAR) AS file, coalesce(string_agg(w, ' ' ORDER BY pos), '') AS lemmas FROM t LEFT JOIN g USING (doc_id) GROUP BY doc_id""")
def _(s, d):
    from tagweave.functions.text import tokens

    word = F.transform(tokens(F.col("text")), lambda x: F.concat(F.lit("0\t"), x, F.lit("\t_\t"), x, F.lit(":s\tsubst")))
    parsed = S.parse_tagged(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.array_join(word, "\n").alias("value")))
    return parsed.select("file", F.array_join("lemmas", " ").alias("lemmas"))


@q("xml_base_tags", "SELECT doc_id AS id, lang || ' ' || source AS lemmas FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def _(s, d):
    docs = table(s, d, "documents").where("lang is not null and source is not null")
    found = S.xml_base_tags(docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("<r><base>"), "lang", F.lit("</base><base>"), "source", F.lit("</base></r>")).alias("xml")))
    return found.select("id", F.array_join("lemmas", " ").alias("lemmas"))


@q("lemmatise_by_service", "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN '' ELSE event_type || ' ' || 'x' END AS lemmas FROM events")
def _(s, d):
    def fetch(text: str) -> tuple[int, str]:
        return (500, "") if text == "error" else (200, f"<r><base>{text}</base><base>x</base></r>")

    found = S.lemmatised(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("text")), fetch)
    return found.select("id", F.array_join("lemmas", " ").alias("lemmas"))


_SNAPSHOT = "id long, text string, observed timestamp, user struct<name: string, url: string>, extended_tweet struct<full_text: string>, retweeted_status struct<id: long, text: string, user: struct<name: string, url: string>>"


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "snapshots")
    user = F.struct(F.concat(F.lit("u"), "user_id").alias("name"), F.lit("-").alias("url"))
    longer = F.when(F.col("event_type") == "click", F.struct(F.concat(F.lit("long "), "props").alias("full_text")))
    inner = F.when(F.col("event_type") == "view", F.struct((F.col("event_id") + 1_000_000_000).alias("id"), F.lit("inner").alias("text"), user.alias("user")))
    rows = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("text"), F.col("ts").alias("observed"), user.alias("user"), longer.alias("extended_tweet"), inner.alias("retweeted_status"))
    rows.write.json(path)
    return S.read_snapshots(s, path, _SNAPSHOT)


@q("read_snapshots", "SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'long ' || props ELSE props END AS text, 'u' || user_id AS name FROM events")
def _(s, d):
    return S.full_text(_snapshots(s, d)).select("id", "text", F.col("user.name").alias("name"))


@q("split_snapshots", "SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'long ' || props ELSE props END AS text, 'original' AS kind FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id + 1000000000, 'inner', 'original' FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, props, 'retweet' FROM events WHERE event_type = 'view'")
def _(s, d):
    own, again = S.split_snapshots(S.full_text(_snapshots(s, d)))
    return own.select("id", "text", F.lit("original").alias("kind")).unionByName(again.select("id", "text", F.lit("retweet").alias("kind")))


@q("drop_nested_fields", "SELECT event_id AS id, 'u' || user_id AS name, 1 AS fields FROM events")
def _(s, d):
    rows = _snapshots(s, d).drop("extended_tweet", "retweeted_status").withColumn("user", F.col("user").dropFields("url"))
    return rows.select("id", "user.name", F.size(F.map_keys(F.from_json(F.to_json("user"), "map<string, string>"))).alias("fields"))


@q("tags_from_literal", sql("ev", "SELECT id, array_to_string(hashtags, ',') AS tags FROM ev"))
def _(s, d):
    literal = F.concat(F.lit("['"), F.array_join("hashtags", "', '"), F.lit("']"))
    wrapped = V.events(s, d).select("id", S.tags_of_literal(literal).alias("hashtags"))
    return wrapped.select("id", F.array_join("hashtags.text", ",").alias("tags"))


@q("convert_vectors", "SELECT 'w' || vec_id AS word, CAST(len(embedding) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[-1] AS DOUBLE), 6) AS last FROM embeddings")
def _(s, d):
    source, target = _folder(s, "vectors"), _folder(s, "converted")
    numbers = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ")
    table(s, d, "embeddings").select(F.concat(F.lit("w"), "vec_id", F.lit(" "), numbers).alias("value")).write.text(source)
    v = S.convert_vectors(s, source, target, "w0")
    return v.select("word", F.size("vector").cast("long").alias("dims"), F.round(F.col("vector")[0], 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))


@q("computed_once", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    path = _folder(s, "once")
    computed_once(s, path, lambda: table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")))
    return computed_once(s, path, lambda: s.createDataFrame([(-1, -1)], "user_id long, n long"))


@q("newest_checkpoint", "SELECT user_id AS model, max(event_id) AS epoch, 'model_' || max(event_id) || '.npz' AS path FROM events GROUP BY 1")
def _(s, d):
    found = table(s, d, "events").select(F.col("user_id").alias("model"), F.concat(F.lit("model_"), "event_id", F.lit(".npz")).alias("path"), F.col("event_id").alias("epoch"))
    return newest(found)


@q("parquet_sink", sql("ev", "SELECT id, username, array_to_string(hashtags, ',') AS tags FROM ev"))
def _(s, d):
    path = _folder(s, "posts")
    V.events(s, d).write.parquet(path)
    return s.read.parquet(path).select("id", "username", F.array_join("hashtags", ",").alias("tags"))


_PLAN = "hashtags:\n  - Click\n  - k9\n  - 'click'\nmentions:\n  - u7\n"


@q("scraping_plan", sql("ev", "SELECT id FROM ev WHERE list_has_any(hashtags, ['click', 'k9']) UNION SELECT id FROM ev WHERE username = 'u7'"))
def _(s, d):
    plan, e = S.scraping_plan(_PLAN), V.events(s, d)
    return S.planned(e, plan["hashtags"]).select("id").unionByName(e.where(F.col("username").isin(plan["mentions"])).select("id")).distinct()


_SUB = """WITH kw AS MATERIALIZED (SELECT word, vector[1] AS first FROM wv WHERE word < 't'), f AS (SELECT id, unnest(lemmas) AS word, generate_subscripts(lemmas, 1) - 1 AS pos FROM dc), u AS (SELECT DISTINCT word, '<' || word || '>' AS w FROM f ANTI JOIN kw USING (word)),
 g AS (SELECT word, unnest(list_transform(range(1, greatest(length(w) - 1, 2)), lambda i: substr(w, i, 3))) AS part FROM u), gb AS (SELECT word, CAST('0x' || md5(part)[1:8] AS BIGINT) % (SELECT count(*) FROM embeddings) AS r FROM g), ev AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), h AS (SELECT word, x FROM gb JOIN ev ON vec_id = r),
 m AS (SELECT word, avg(x) AS first FROM h GROUP BY 1) SELECT id, pos, word, round(coalesce(kw.first, m.first), 6) + 0e0 AS first FROM f LEFT JOIN kw USING (word) LEFT JOIN m USING (word)"""


@q("lemma_vector_always", sql("wv", _SUB))
def _(s, d):
    buckets = table(s, d, "embeddings").select(F.col("vec_id").alias("bucket"), F.col("embedding").cast("array<double>").alias("vector"))
    p = V.posts(s, d)
    found = embed.lookup_always(p, V.word_vectors(s, d, p).where("word < 't'"), buckets)
    return found.select("id", F.col("pos").cast("long").alias("pos"), "word", (F.round(F.col("vector")[0], 6) + 0.0).alias("first"))


@q("rank_higher_on_ties", sql("ev", "WITH c AS (SELECT username, h AS hashtag, count(*) AS n FROM (SELECT username, unnest(hashtags) AS h FROM ev) GROUP BY 1, 2) SELECT username, hashtag, n, row_number() OVER (PARTITION BY username ORDER BY n DESC, hashtag DESC) AS rank FROM c"))
def _(s, d):
    c = V.events(s, d).select("username", F.explode("hashtags").alias("hashtag")).groupBy("username", "hashtag").agg(F.count("*").alias("n"))
    order = Window.partitionBy("username").orderBy(F.desc("n"), F.desc("hashtag"))
    return c.withColumn("rank", F.row_number().over(order).cast("long"))


@q("preview_head", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 5")
def _(s, d):
    return table(s, d, "events").select("event_id", "event_type").orderBy("event_id").limit(5)


@q("renumber_rows", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events")
def _(s, d):
    return in_order(table(s, d, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", (F.col("n") - 1).alias("idx"))


@q("column_difference", "SELECT column_name AS name FROM (DESCRIBE events) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE documents)) AND column_name <> 'ts'")
def _(s, d):
    only = set(table(s, d, "events").columns) - set(table(s, d, "documents").columns) - {"ts"}
    return s.createDataFrame([(c,) for c in sorted(only)], "name string")


@q("one_hot_labels", sql("evflat", "WITH l AS (SELECT hashtag, row_number() OVER (ORDER BY hashtag) - 1 AS idx FROM (SELECT DISTINCT hashtag FROM evflat)) SELECT id, idx, 1e0 AS value FROM (SELECT DISTINCT id, hashtag FROM evflat) JOIN l USING (hashtag)"))
def _(s, d):
    """One row for each coordinate that is not 0."""
    flat = V.events(s, d).select("id", F.explode("hashtags").alias("hashtag")).distinct()
    labels = in_order(flat.select("hashtag").distinct(), "hashtag")
    return flat.join(labels, "hashtag").select("id", (F.col("n") - 1).alias("idx"), F.lit(1.0).alias("value"))


@q("fn_format", "SELECT event_id, printf('%.2f', user_id / 4) AS x FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.format_string("%.2f", F.col("user_id") / 4).alias("x"))


@q("fn_suffix", sql("ev", "SELECT id, username || '_user' AS a, username AS b, array_to_string(list_transform(hashtags, lambda x: x || '_tag'), ',') AS c FROM ev"))
def _(s, d):
    a = F.concat("username", F.lit("_user"))
    return V.events(s, d).select("id", a.alias("a"), F.regexp_replace(a, "_user$", "").alias("b"), F.array_join(F.transform("hashtags", lambda x: F.concat(x, F.lit("_tag"))), ",").alias("c"))


@q("align_lists", sql("dc", "SELECT id, pos - 1 AS pos, hashtags[pos] AS tag, lemmas[pos] AS lemma FROM (SELECT *, unnest(range(1, 1 + least(len(hashtags), len(lemmas)))) AS pos FROM dc)"))
def _(s, d):
    zipped = F.slice(F.arrays_zip("hashtags", "lemmas"), F.lit(1), F.least(F.size("hashtags"), F.size("lemmas")))
    return V.documents(s, d).select("id", F.posexplode(zipped).alias("pos", "z")).select("id", F.col("pos").cast("long").alias("pos"), F.col("z.hashtags").alias("tag"), F.col("z.lemmas").alias("lemma"))


_EVENT = "id long, username string, created_at timestamp, retweet_count long, hashtags array<string>"


def _fed(s: SparkSession, d: str) -> DataFrame:
    """Posts as a stream of a folder of JSON files, a few files a batch, in the order of their time."""
    path = _folder(s, "feed")
    V.events(s, d).repartitionByRange(6, "created_at").sortWithinPartitions("created_at").write.json(path)
    return T.growing(s, path, _EVENT, "*.json", 2)


@q("stream_growing_directory", sql("ev", "SELECT id, username, array_to_string(hashtags, ',') AS tags FROM ev"))
def _(s, d):
    out = _folder(s, "stream")
    T.drained(_fed(s, d).select("id", "username", F.array_join("hashtags", ",").alias("tags")), out, f"{out}-checkpoint")
    return s.read.parquet(out)


def _counted(s: SparkSession, stream: DataFrame, window: str) -> DataFrame:
    out = _folder(s, "stream")
    T.drained(stream, out, f"{out}-checkpoint", "complete")
    rows = s.read.parquet(out)
    return rows.select(F.unix_timestamp(F.col(f"{window}.start")).alias("start"), F.unix_timestamp(F.col(f"{window}.end")).alias("end"), "hashtag", "n")


@q("stream_tag_counts", sql("ev", "SELECT epoch(created_at)::BIGINT // 86400 * 86400 AS start, epoch(created_at)::BIGINT // 86400 * 86400 + 86400 AS \"end\", h AS hashtag, count(*) AS n FROM (SELECT date_trunc('day', created_at) AS created_at, unnest(hashtags) AS h FROM ev) GROUP BY 1, 2, 3"))
def _(s, d):
    return _counted(s, T.tag_counts(_fed(s, d), "created_at", "1 day", "10 days"), "window")


@q("stream_tag_counts_sliding", sql("ev", "SELECT start, start + 86400 AS \"end\", hashtag, count(*) AS n FROM (SELECT h AS hashtag, unnest([t // 43200 * 43200, t // 43200 * 43200 - 43200]) AS start FROM (SELECT epoch(date_trunc('second', created_at))::BIGINT AS t, unnest(hashtags) AS h FROM ev)) GROUP BY 1, 2, 3"))
def _(s, d):
    return _counted(s, T.tag_counts(_fed(s, d), "created_at", "1 day", "10 days", "12 hours"), "window")


@q("stream_tag_sessions", sql("ev", """WITH f AS (SELECT epoch_us(created_at) AS t, unnest(hashtags) AS h FROM ev), g AS (SELECT h, t, CASE WHEN t - lag(t) OVER w < 3600000000 THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY h ORDER BY t)),
 x AS (SELECT h, t, sum(fresh) OVER (PARTITION BY h ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT CAST(min(t) // 1000000 AS BIGINT) AS start, CAST((max(t) + 3600000000) // 1000000 AS BIGINT) AS "end", h AS hashtag, count(*) AS n FROM x GROUP BY h, x.n"""))
def _(s, d):
    return _counted(s, T.tag_sessions(_fed(s, d), "created_at", "1 hour", "10 days"), "session_window")


@q("stream_latest", sql("ev", "SELECT username, id, retweet_count FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY date_trunc('hour', created_at) DESC, id) AS n FROM ev) WHERE n = 1"))
def _(s, d):
    rows = _fed(s, d).select("username", F.date_trunc("hour", "created_at").alias("hour"), "id", "retweet_count")
    out = _folder(s, "stream")
    T.drained(T.latest_versions(rows, "username", "hour", "id"), out, f"{out}-checkpoint", "complete")
    return s.read.parquet(out).select("username", "id", "retweet_count")
