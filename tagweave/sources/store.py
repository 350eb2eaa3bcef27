"""Saved state of loops, results computed once, and the newest of several model folders."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset and all executors are threads of this process, a temporary folder that goes at exit; else an error.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tagweave-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df with its lineage cut: written as Parquet and read again. A lost executor costs no recomputation of what came before."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Delete a table made by saved() that nothing reads any more."""
    if path := getattr(df, "_saved_path", None):
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def computed_once(spark: SparkSession, path: str, make) -> DataFrame:
    """make()'s rows, written to path unless a finished table is there already."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def newest(checkpoints: DataFrame) -> DataFrame:
    """checkpoints (model, path, epoch) -> each model's path of the highest epoch."""
    return checkpoints.groupBy("model").agg(F.max_by("path", "epoch").alias("path"), F.max("epoch").alias("epoch"))
