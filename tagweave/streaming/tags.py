"""Streaming forms of the snapshot and popularity operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def growing(spark: SparkSession, path: str, schema: str, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    """A stream of the JSON lines of a folder that files are added to."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).json(path)


def tag_counts(posts: DataFrame, time: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """How often each tag occurs in each event-time window (tumbling, or sliding by `slide`); posts later than `late` are left out."""
    flat = posts.withWatermark(time, late).select(F.col(time).alias("_t"), F.explode("hashtags").alias("hashtag"))
    return flat.groupBy(F.window("_t", window, slide) if slide else F.window("_t", window), "hashtag").agg(F.count("*").alias("n"))


def tag_sessions(posts: DataFrame, time: str, gap: str, late: str) -> DataFrame:
    """How often each tag occurs in each of its sessions, which end when it rests for `gap`."""
    flat = posts.withWatermark(time, late).select(F.col(time).alias("_t"), F.explode("hashtags").alias("hashtag"))
    return flat.groupBy(F.session_window("_t", gap), "hashtag").agg(F.count("*").alias("n"))


def latest_versions(rows: DataFrame, key: str, time: str, arrival: str) -> DataFrame:
    """The latest version of each key by `time`, of equal times the first by `arrival` (a number), as keyed state.

    State holds one row a key; a batch touches the keys it has. For a stream use output mode update, or complete.
    """
    others = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*others), F.struct(F.col(time), -F.col(arrival)))
    return rows.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")


def keep_latest(batches: DataFrame, key: str, time: str, arrival: str, put, checkpoint: str):
    """A running query that gives put(rows, epoch) the keys that a batch changed, each in its latest version."""
    return latest_versions(batches, key, time, arrival).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).start()


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now and stop. Append and complete write Parquet; complete keeps the last result."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda rows, epoch: rows.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
