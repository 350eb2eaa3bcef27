"""Mixing sources to target weights: fixed-length blocks, multinomial counts per output shard, permuted block indexes.

A source's documents, in a pseudorandom order, are one stream of words, cut into blocks of `block_words`. A source
with a target of t words gets as many slots as t words fill; the slots of a shard are drawn so that, over all shards,
every source has exactly its number (multinomial draws conditional on their totals, within strata of STRATUM shards
that each hold their even share). Slot j of a source reads block
`permutation_epoch(j mod blocks)` of epoch `j div blocks`, so no block comes again before all have come. Blocks and
slots meet in a join on (source, block).

Defined cases: null text has size 0; a null source is a source of its own, after all others; a null or repeated
doc_id is only carried along, each row counts by itself (a source's stream goes by hash of id and text); a source without words has target 0; an empty table gives an
empty result; other columns are ignored by mix() and kept by take_mixed().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tagweave.llm._bytes import mix as scramble
from tagweave.llm._bytes import pieces, text_bytes, words
from tagweave.llm._store import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
BLOCK_WORDS = 256
SHARD_SLOTS = 65_536
BUCKET_ROWS, LEAST_BUCKETS = 2_000, 256
STRATUM = 8_192  # shards
CUT_BYTES = 1 << 22
MOST_REPEATS = 3
MOST_SOURCES = 1_000_000
SEED = 20_011


def sizes(docs: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, order and the key columns): size is the number of words of the whole text."""
    words_ = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*key, "doc_id", "source", words_.alias("size"), F.xxhash64("doc_id", "text").alias("order"))


def shared_targets(sizes_: list[int], weights: list[float], repeats: int = MOST_REPEATS) -> list[float]:
    """Targets that share the sum of sizes by weight and stop at `repeats` times a size; the others share the excess.

    In rising order of cap over weight the capped ones come first: one pass finds the common factor of the others.
    """
    caps = [float(n * repeats) for n in sizes_]
    left, rest = float(sum(sizes_)), float(sum(weights))
    out = caps[:]
    by_room = sorted(range(len(caps)), key=lambda i: (caps[i] / weights[i], i))
    for n, i in enumerate(by_room):
        factor = left / rest
        if factor <= caps[i] / weights[i]:
            for j in by_room[n:]:
                out[j] = min(caps[j], factor * weights[j])
            break
        left, rest = left - caps[i], rest - weights[i]
    return out


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> list[dict]:
    """source, source_index, source_size and target of every source, by code point, null last.

    This table of metadata has one row per source and comes to the driver; above MOST_SOURCES rows it is refused.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    share = [float(weights[i % len(weights)]) for i in range(len(rows))]
    targets = shared_targets([r["source_size"] for r in rows], share, repeats)
    return [{"source": r["source"], "source_index": i, "source_size": r["source_size"], "target": t} for i, (r, t) in enumerate(zip(rows, targets, strict=True))]


def _keys(seed: int, source: int, epoch: int) -> np.ndarray:
    return scramble(np.arange(4, dtype=np.uint64) + np.uint64(seed * 1_000_003 + source * 64 + epoch) * np.uint64(8191))


def permuted(index: np.ndarray, n: int, keys: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at `index`: four Feistel rounds, walked until the value is below n."""
    half = np.uint64(max(1, ((max(n - 1, 1)).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & mask
        for k in keys[::-1] if back else keys:
            if back:
                a, b = b ^ (scramble(a ^ k) & mask), a
            else:
                a, b = b, a ^ (scramble(b ^ k) & mask)
        return (a << half) | b

    out = once(index.astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = once(out[far])
    return out.astype(np.int64)


def _quota(row: dict, block: int, seed: int) -> dict:
    """How many slots a source's target fills, and the words of the last one."""
    size, want = int(row["source_size"]), int(round(row["target"]))
    blocks = -(-size // block)
    if not size or not want:
        return {"blocks": max(blocks, 1), "slots": 0, "last": block}
    short = size - (blocks - 1) * block
    epochs, rest = divmod(want, size)
    at = int(permuted(np.array([blocks - 1]), blocks, _keys(seed, row["source_index"], epochs), back=True)[0])
    if rest <= at * block:
        full, part = divmod(rest, block)
    else:
        full, part = divmod(rest - at * block - short, block)
        full, part = (full + at + 1, part) if rest >= at * block + short else (at, rest - at * block)
    return {"blocks": blocks, "slots": epochs * blocks + full + (part > 0), "last": part or block}


def _drawn(rng: np.random.Generator, pool: np.ndarray, n: int) -> np.ndarray:
    """n slots drawn from the pool without replacement: how many of each source."""
    out, left = np.zeros_like(pool), int(pool.sum())
    for i, have in enumerate(pool.tolist()):
        rest = left - have
        out[i] = got = int(rng.hypergeometric(have, rest, n)) if n else 0
        n, left = n - got, rest
    return out


def shard_counts(slots: np.ndarray, shard: int, shards: int, per_shard: int, seed: int, stratum: int = STRATUM) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in one shard, and how many earlier shards hold; any shard by itself, by halving the range.

    Shards are drawn within strata of `stratum` shards; each stratum has its even share of every source.
    """
    k = shard // stratum
    bounds = [min(x * stratum, shards) for x in (k, k + 1)]
    upto = [np.array([int(s) * x // shards for s in slots.tolist()], np.int64) for x in bounds]
    pool, before = upto[1] - upto[0], upto[0]
    low, high = bounds
    each = -(-int(pool.sum()) // max(1, high - low))
    while high - low > 1:
        mid = (low + high) // 2
        left = _drawn(np.random.default_rng([seed, low, high]), pool, min((mid - low) * each, int(pool.sum())))
        if shard < mid:
            pool, high = left, mid
        else:
            before, pool, low = before + left, pool - left, mid
    return pool, before


def mix_plan(spark, rows: list[dict], block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, source_index, slot, epoch, block, words): one row per slot; words is how many of its block's words it takes."""
    quota = [_quota(r, block_words, seed) for r in rows]
    slots = np.array([q["slots"] for q in quota], np.int64)
    shards = max(1, -(-int(slots.sum()) // shard_slots))

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"].tolist():
                counts, before = shard_counts(slots, shard, shards, shard_slots, seed)
                for s, n in enumerate(counts.tolist()):
                    if not n:
                        continue
                    slot = np.arange(before[s], before[s] + n)
                    epoch, index = np.divmod(slot, quota[s]["blocks"])
                    block = np.empty_like(index)
                    for e in np.unique(epoch).tolist():
                        block[epoch == e] = permuted(index[epoch == e], quota[s]["blocks"], _keys(seed, s, e))
                    taken = np.where(slot == quota[s]["slots"] - 1, quota[s]["last"], block_words)
                    yield pd.DataFrame({"shard": shard, "source_index": s, "slot": slot, "epoch": epoch, "block": block, "words": taken})

    kind = "shard long, source_index int, slot long, epoch long, block long, words long"
    return spark.range(0, shards, 1, min(shards, 4096)).mapInPandas(plan, kind)


def placed(sized: DataFrame, targets: DataFrame, rows: int, key: tuple[str, ...] = ()) -> DataFrame:
    """Each row with its source's index and `start`: the words of the source's stream before it.

    The running sum is taken in buckets of about BUCKET_ROWS rows, then over the buckets, so a source with most of
    the rows is spread over many tasks.
    """
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    one = sized.join(F.broadcast(targets), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    one = one.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    inside = Window.partitionBy("source_index", "bucket").orderBy("order", "doc_id", "size", *key).rowsBetween(Window.unboundedPreceding, -1)
    sums = one.groupBy("source_index", "bucket").agg(F.sum("size").alias("in_bucket"))
    over = Window.partitionBy("source_index").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_index", "bucket", F.coalesce(F.sum("in_bucket").over(over), F.lit(0)).alias("bucket_start"))
    one = one.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["source_index", "bucket"])
    return one.select(*key, "doc_id", "source_index", "size", "source_size", "target", (F.col("bucket_start") + F.col("start")).alias("start"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = SEED, key: tuple[str, ...] = (), shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source_index), a row for each row of docs (doc_id, source, text).

    key names columns of docs that tell its rows apart. With it the result has them too, and copies, how often all of
    the row's words are drawn, and drawn, the ranges (low, high) of its words that are drawn once more. A block comes
    once an epoch, so only the last epoch leaves ranges. The table of sources is broadcast: it is checked to hold at
    most MOST_SOURCES rows.
    """
    spark = docs.sparkSession
    sized = written(sizes(docs, key), "sizes")
    sources = source_targets(sized, weights)
    plan = mix_plan(spark, sources, block_words, shard_slots, seed)
    table = spark.createDataFrame([tuple(r.values()) for r in sources], "source string, source_index int, source_size long, target double")
    where = placed(sized, table, sized.count(), key)
    whole = F.col("words") == block_words
    drawn = plan.groupBy("source_index", "block").agg(F.sum(whole.cast("long")).alias("times"), F.coalesce(F.sum(F.when(~whole, F.col("words"))), F.lit(0)).alias("part"))
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut = where.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
    cut = cut.withColumn("low", F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0)))
    cut = cut.withColumn("high", F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words)))
    met = cut.join(drawn.hint("merge"), ["source_index", "block"])  # its size is not known before it runs
    some_words = F.col("times") * (F.col("high") - F.col("low")) + F.greatest(F.least("high", "part") - F.col("low"), F.lit(0))
    sums = [F.sum(some_words).alias("words_taken")]
    if key:
        at = F.col("block") * block_words - F.col("start")
        sums += [F.sum(F.col("high") - F.col("low")).alias("met"), F.min("times").alias("least")]
        sums += [F.array_sort(F.collect_list(F.struct((at + F.col("low")).alias("low"), (at + F.col("high")).alias("high"), (at + F.least("high", "part")).alias("part"), "times"))).alias("blocks")]
    taken = met.groupBy("source_index", "start").agg(*sums).withColumn("some", F.lit(True))
    out = where.withColumn("some", F.col("size") > 0).join(taken, ["source_index", "start", "some"], "left")
    names = [*key, "doc_id", "size", "source_size", "target", F.coalesce("words_taken", F.lit(0)).cast("long").alias("taken"), "source_index"]
    if key:
        out = out.withColumn("copies", F.expr("if(met = size, least, 0L)"))
        ranges = "filter(transform(blocks, b -> named_struct('low', b.low, 'high', if(b.times > copies, b.high, b.part))), r -> r.high > r.low)"
        names += [F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), F.expr(f"cast({ranges} as array<struct<low: long, high: long>>)").alias("drawn")]
    return out.select(*names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with each text that has ranges cut to them. A word keeps the space before it; a gap adds a line end."""
    for batch in pieces(batches, "text", CUT_BYTES):
        ranges, text = batch.column("_drawn"), batch.column("text")
        data, off = text_bytes(text.filter(ranges.is_valid()))
        _, ends, upto = words(data, off)
        made = []
        for i, own in enumerate(ranges.drop_null().to_pylist()):
            stop, runs = ends[upto[i] : upto[i + 1]], []
            for r in own:
                if runs and runs[-1][1] == r["low"]:
                    runs[-1][1] = r["high"]
                else:
                    runs.append([r["low"], r["high"]])
            made.append("\n".join(data[stop[low - 1] if low else off[i] : stop[high - 1]].tobytes().decode() for low, high in runs))
        cut = pc.replace_with_mask(text, ranges.is_valid(), pa.array(made, text.type))
        names = [c for c in batch.schema.names if c != "_drawn"]
        yield pa.record_batch([cut if c == "text" else batch.column(c) for c in names], names)


KEY = ("_mix_file", "_mix_at")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with the columns KEY, which tell its rows apart, the same whenever it is read again.

    Rows read from files go by file and place in it; other rows are written to the shared folder with numbers first.
    """
    try:
        return docs.withColumn(KEY[0], F.xxhash64("_metadata.file_path")).withColumn(KEY[1], F.col("_metadata.row_index"))
    except AnalysisException:
        return written(docs.withColumn(KEY[0], F.lit(0).cast("long")).withColumn(KEY[1], F.monotonically_increasing_id()), "numbered")


def take_mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of docs (doc_id, text, source, ...) as often as the mix takes them.

    A row comes whole as often as all its words are drawn, and once more with just the words that are drawn beyond
    that. Rows are told apart by file and place or by number, so null and repeated ids are no matter. All columns stay
    as they are but text and n_chars (and a column named _drawn, which goes).
    """
    rows = numbered(docs)
    much = mix(rows, weights, block_words, seed, KEY).where("taken > 0").select(*KEY, F.col("copies").alias("_mix_copies"), F.col("drawn").alias("_drawn"))
    whole = F.array_repeat(F.lit(None).cast(much.schema["_drawn"].dataType), F.col("_mix_copies").cast("int"))
    once = F.filter(F.array("_drawn"), lambda r: F.size(r) > 0)
    out = rows.drop("_drawn").join(much, list(KEY)).select(*[c for c in docs.columns if c != "_drawn"], F.explode(F.concat(whole, once)).alias("_drawn"))
    out = out.mapInArrow(_cut, StructType([f for f in docs.schema.fields if f.name != "_drawn"]))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
