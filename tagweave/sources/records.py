"""Readers for the text formats: key-value records, tagger output, post snapshots, vectors, XML answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.sources.store import saved

#: The keys of a record and the mark between records.
KEYS = ("Type", "Origin", "Text", "URL", "ID", "Time", "RetCount", "Favorite", "MentionedEntities", "Hashtags")
MARK = "***"
MULTILINE = ("Text", "Origin")
#: Files that are parsed into one batch.
FILES = 256
#: Records that make a batch.
RECORDS = 4096


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file, value): whole files below path whose names match."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def read_lines(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file, at, value): the lines of the files below path whose names match; no task holds a file.

    at is where the part of the file that is read with a line begins: a large file is read in several parts.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    return lines.select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def parse_records(texts: DataFrame, least_tags: int = 0, strict_compat: bool = False) -> DataFrame:
    """texts -> one row per closed record with at least least_tags tags.

    texts is (file, value), a row a whole file, or (file, at, value), pieces of a file that are whole lines without the
    last line end: those of the same at lie in order, one after the other, in one partition (read_lines; sorted files).

    A line whose key is none of KEYS goes on with the latest multi-line field; a file in which one comes before the
    record has such a field is dropped. strict_compat: least_tags 0 keeps nothing.

    Pieces are parsed as a stream, a record at a time, and twice: first for what lies across the edges of parts and for
    the files to drop, then for the records within the parts. No line is shuffled.
    """
    if strict_compat and least_tags == 0:
        texts = texts.where(F.lit(False))
    pieces = texts if "at" in texts.columns else texts.select("file", F.lit(0).cast("long").alias("at"), F.explode(F.split("value", "\n")).alias("value"))
    pieces = pieces.select("file", F.col("at").cast("long").alias("at"), F.make_valid_utf8("value").alias("value")).where("value is not null")
    kind, names = texts.schema["file"].dataType.simpleString(), ", ".join(f"{k} string" for k in KEYS)
    edges = pieces.mapInArrow(_edges, f"file {kind}, at long, n long, marked boolean, part array<string>, multi long, orphan long")
    edges = edges.repartition("file").sortWithinPartitions("file", "at", "n")
    joined = saved(edges.mapInArrow(_across, f"file {kind}, at long, before long, record long, {names}"), "across")
    parts = joined.where("record is null").select(F.col("file").alias("_file"), F.col("at").alias("_at"), "before")
    inner = pieces.mapInArrow(_within, f"file {kind}, at long, n long, {names}").join(parts, F.col("file").eqNullSafe(F.col("_file")) & (F.col("at") == F.col("_at")))
    inner = inner.select("file", (F.col("before") + F.col("n")).alias("record"), *KEYS)
    wide = inner.unionByName(joined.where("record is not null").select("file", "record", *KEYS))

    def listed(name: str):
        return F.when(F.coalesce(F.col(name), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(name, " "))

    wide = wide.withColumns({"RetCount": F.col("RetCount").cast("int"), "Favorite": F.coalesce(F.col("Favorite") != "", F.lit(False)), "Hashtags": listed("Hashtags"), "MentionedEntities": listed("MentionedEntities")})
    return wide.where(F.size("Hashtags") >= least_tags)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, at, n, lines, marked): the lines of a part up to its n-th mark; marked is false where the part ends first."""
    own, n, lines = None, 0, []
    for batch in batches:
        if not batch.num_rows:
            continue
        file, at, values = batch.column("file"), batch.column("at"), batch.column("value")
        codes = file.dictionary_encode("encode").indices.to_numpy()
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(at.to_numpy()) != 0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if (key := (file[low].as_py(), at[low].as_py())) != own:
                if own is not None:
                    yield *own, n, lines, False
                own, n, lines = key, 0, []
            for value in values.slice(low, high - low).to_pylist():
                for line in value.split("\n"):
                    if MARK in line and line.strip(" ") == MARK:
                        yield *own, n, lines, True
                        n, lines = n + 1, []
                    else:
                        lines.append(line)
    if own is not None:
        yield *own, n, lines, False


def _fields(lines: list[str]) -> tuple[dict[str, str], bool, bool]:
    """A record's fields, whether one of them may go on over lines, and whether a line stands before such a field."""
    found: dict[str, str] = {}
    last, orphan = None, False
    for line in lines:
        name, colon, rest = line.partition(":")
        if colon and name in KEYS:
            found[name] = found.get(name, "") + rest.strip(" ")
            last = name if name in MULTILINE else last
        elif last:
            found[last] += f"\n{line}\n"
        elif line:
            orphan = True
    return found, last is not None, orphan


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part the lines before its first and after its last mark; with the latter, its first record between them that
    has a multi-line field and its last one with a line before such a field."""
    multi = orphan = None
    names = ["file", "at", "n", "marked", "part", "multi", "orphan"]
    for file, at, n, lines, marked in _cut(batches):
        multi, orphan = (multi, orphan) if n else (None, None)
        if n and marked:
            _, many, lone = _fields(lines)
            multi, orphan = n if many and multi is None else multi, n if lone else orphan
        else:
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.int64()]
            yield pa.record_batch([_own(file, 1), *(pa.array([x], k) for x, k in zip((at, n, marked, lines, multi, orphan), kinds, strict=True))], names)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in the order of files -> the parts of files that are kept, with the records before each, and the records across edges."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for file, edges in groupby(rows, key=itemgetter("file")):
        parts, records, lines, number, seen, bad = [], [], [], 0, False, False
        for e in edges:
            if e["n"] == 0:
                parts.append((e["at"], number))
                lines += e["part"]
            if e["marked"]:
                found, many, lone = _fields(lines)
                bad, seen = bad or (lone and seen), seen or many
                records += [(number, found)] if found else []
                number, lines = number + 1, []
            elif e["n"]:
                multi, orphan = e["multi"], e["orphan"]
                bad = bad or (orphan is not None and (seen or (multi is not None and multi < orphan)))
                number, seen, lines = number + e["n"] - 1, seen or multi is not None, list(e["part"])
        if not (bad or (_fields(lines)[2] and seen)):
            blank = [{}] * len(parts)
            ends = [[at for at, _ in parts] + [None] * len(records), [n for _, n in parts] + [None] * len(records), [None] * len(parts) + [n for n, _ in records]]
            yield _batch(file, ends, ["at", "before", "record"], blank + [found for _, found in records])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records between the first and the last mark of each part."""
    own, numbers, records = None, [], []
    for file, at, n, lines, marked in _cut(batches):
        if records and ((file, at) != own or len(records) == RECORDS):
            yield _batch(own[0], [[own[1]] * len(records), numbers], ["at", "n"], records)
            numbers, records = [], []
        own = file, at
        if n and marked and (found := _fields(lines)[0]):
            numbers.append(n)
            records.append(found)
    if records:
        yield _batch(own[0], [[own[1]] * len(records), numbers], ["at", "n"], records)


def _own(file: str | None, n: int) -> pa.Array:
    return pa.array([file] * n, pa.string() if file is None else None)


def _batch(file: str | None, numbers: list[list[int | None]], names: list[str], records: list[dict[str, str]]) -> pa.RecordBatch:
    columns = [_own(file, len(records)), *(pa.array(x, pa.int64()) for x in numbers), *(pa.array([r.get(k) for r in records], pa.string()) for k in KEYS)]
    return pa.record_batch(columns, ["file", *names, *KEYS])


def save_per_file(records: DataFrame, path: str, merged: bool = False) -> None:
    """CSV, a folder for each input file, or one folder for all; finished output is left as it is.

    merged leaves as many part files as there are tasks: a reader takes the folder as one table.
    """
    flat = records.withColumns({c: F.array_join(c, " ") for c in ("Hashtags", "MentionedEntities")})
    writer = flat.write if merged else flat.write.partitionBy("file")
    writer.mode("ignore").options(header=True, compression="gzip", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and a declared schema; only `columns` are parsed."""
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    return table.select(*columns) if columns else table


def read_csv_of_users(spark: SparkSession, path: str, schema: str, column: str, user: str = "username") -> DataFrame:
    """One column of a folder of CSV files, with the user that each file's name (<user>.csv or <user=...>/) gives."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(?:user=([^/]+)/[^/]+|/([^/]+)\.csv[^/]*)$", 0)
    of = F.coalesce(F.nullif(F.regexp_extract(name, r"user=([^/]+)/", 1), F.lit("")), F.regexp_extract(name, r"/([^/]+)\.csv", 1))
    return spark.read.option("header", True).option("recursiveFileLookup", True).schema(schema).csv(path).select(F.col(column), F.url_decode(of).alias(user))


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Snapshots, one JSON object a line, of a declared schema; lines that are none are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tags_of_literal(column: Column) -> Column:
    """A list literal such as ['a', 'b'] as array<struct<text>>, parsed as data, never run."""
    plain = F.from_json(F.translate(column, "'", '"'), "array<string>")
    return F.transform(plain, lambda x: F.struct(x.alias("text")))


def scraping_plan(text: str) -> dict[str, list[str]]:
    """The lists of a plain YAML plan: `name:` lines with `- value` lines below."""
    out: dict[str, list[str]] = {}
    name = ""
    for line in text.splitlines():
        bare = line.strip()
        if bare.endswith(":") and not bare.startswith("-"):
            name = bare[:-1].strip()
            out[name] = []
        elif bare.startswith("-") and name:
            out[name].append(bare[1:].strip().strip("'\""))
    return out


def planned(posts: DataFrame, tags: list[str]) -> DataFrame:
    """Posts with a tag of the plan; an entry that stands twice counts once, case does not count."""
    wanted = F.array(*[F.lit(t) for t in sorted({t.lower() for t in tags})])
    return posts.where(F.arrays_overlap(F.transform("hashtags", F.lower), wanted))


def lemmatised(texts: DataFrame, fetch: Callable[[str], tuple[int, str]]) -> DataFrame:
    """texts (id, text) -> (id, lemmas): the base elements of what the service answers, none unless its status is 200.

    fetch is called on the executors, text by text; it returns status and XML. A call that fails gives no lemmas.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = []
            for text in batch.column("text").to_pylist():
                try:
                    status, xml = fetch(text or "")
                except OSError:
                    status, xml = 0, ""
                answers.append(xml if status == 200 else None)
            yield pa.record_batch({"id": batch.column("id"), "xml": pa.array(answers, pa.string())})

    kind = texts.schema["id"].dataType.simpleString()
    answered = xml_base_tags(texts.select("id", "text").mapInArrow(ask, f"id {kind}, xml string"))
    return answered.select("id", F.coalesce("lemmas", F.array().cast("array<string>")).alias("lemmas"))


def parse_tagged(texts: DataFrame) -> DataFrame:
    """Tagger TSV (file, value) -> (file, lemmas): no punctuation rows, first row of each surface form, lemma before the colon.

    A file is one row and is parsed in it; lines are not shuffled.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                part = batch.slice(at, FILES)
                lemmas = [_first_lemmas(*x) for x in zip(part.column("value").to_pylist(), part.column("low").to_pylist(), strict=True)]
                yield pa.record_batch([part.column("file"), pa.array(lemmas, pa.list_(pa.string()))], ["file", "lemmas"])

    kind = texts.schema["file"].dataType.simpleString()
    return texts.select("file", "value", F.lower("value").alias("low")).mapInArrow(parsed, f"file {kind}, lemmas array<string>")


def _first_lemmas(value: str | None, low: str | None) -> list[str]:
    """The lemmas of a tagger's text; low is the same text in lower case."""
    found: dict[str, str] = {}
    for line, lower in zip((value or "").split("\n"), (low or "").split("\n"), strict=True):
        cells = line.split("\t")
        if len(cells) >= 5 and cells[1] not in found and cells[4].strip(" ") != "interp":
            found[cells[1]] = lower.split("\t", 4)[3].split(":", 1)[0]
    return list(found.values())


def xml_base_tags(answers: DataFrame) -> DataFrame:
    """(id, xml) -> (id, lemmas): the text of all base elements."""
    return answers.select("id", F.expr("xpath(xml, '//base/text()')").alias("lemmas"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A text file of a word and its numbers per line -> (word, vector)."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, 1 << 20), lambda x: x.cast("double")).alias("vector")).where(F.size("vector") > 1)


def convert_vectors(spark: SparkSession, source: str, target: str, probe: str) -> DataFrame:
    """source's vectors as Parquet at target, once; the probe word must come through unchanged."""
    read_vectors(spark, source).write.mode("overwrite").parquet(target)
    back = spark.read.parquet(target)
    if read_vectors(spark, source).where(F.col("word") == probe).exceptAll(back).count():
        raise ValueError(f"{probe} did not come through the conversion")
    return back


def split_snapshots(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw snapshots -> (originals, retweets). A retweet's original becomes a row of its own, observed when the retweet was."""
    own = raw.where("retweeted_status is null").select(*[c for c in raw.columns if c != "retweeted_status"])
    again = raw.where("retweeted_status is not null")
    inner = again.select("retweeted_status.*", "observed") if "observed" not in raw.schema["retweeted_status"].dataType.names else again.select("retweeted_status.*")
    return own.unionByName(inner, allowMissingColumns=True), again.drop("retweeted_status")


def full_text(raw: DataFrame) -> DataFrame:
    """The extended form, where there is one, in place of the short text."""
    return raw.withColumn("text", F.coalesce("extended_tweet.full_text", "text")).drop("extended_tweet")


def latest(rows: DataFrame, key: str, time: str, arrival: str) -> DataFrame:
    """The latest row of each key; of equal times the first that arrived."""
    order = Window.partitionBy(key).orderBy(F.desc(time), F.asc(arrival))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
