"""Session factory used by the command line, the tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "tagweave", cores: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session: UTC, AQE on, shuffle partitions in proportion to the cores.

    On a cluster the master and the sizes come from spark-submit; the factory sets only what is unset.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", os.environ.get("TAGWEAVE_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
