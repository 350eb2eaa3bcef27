"""A training-data pipeline: five stages over documents, each written as Parquet and read again by the next.

language_id   documents of no recognised or of an ambiguous language go; a missing lang is filled in
ngram_dedup   of each group of near-duplicates the one with the smallest id stays
pii           spans of personal data are replaced by their kind in brackets
mixing        sources are brought to their target weights: documents come whole, in part, or several times
packing       texts become token sequences; one row per piece

All stages but the last return the columns of documents. SQL cannot express the learned and iterative stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.llm import language, mixing, ngram_join, packing, pii
from tagweave.llm._store import drop_written, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs.select("doc_id", "text", "lang"))
    found = language.identify(docs.select(*COLUMNS), model).where("lang_pred <> 'und' and not ambiguous")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share an id are one document here: one of them stays. Rows with a null id all stay."""
    groups = ngram_join.link_groups(docs.select("doc_id", "text"), count_links=False)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = docs.select(*COLUMNS).join(kept, "doc_id").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return one.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs.select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mixed(docs).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("ngram_dedup", ngram_dedup),
    ("pii", pii_redaction),
    ("mixing", source_mixing),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
