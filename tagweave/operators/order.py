"""Numbers of rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.sources.store import saved


def in_order(rows: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """rows with `name`, their numbers from 1 in the given order, which has to tell all rows apart.

    Rows are dealt into ranges and numbered within each; the ranges' sizes, one row a range, give the offsets.
    """
    sort = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = saved(rows.repartitionByRange(*sort).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_range", before.alias("_before")))  # as many rows as shuffle partitions
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*sort))
    return dealt.withColumn(name, within).join(starts, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def quantile_marks(rows: DataFrame, column: str, shares: list[float], tie: str) -> DataFrame:
    """(share, mark) of a column's linearly interpolated quantiles, from the numbered rows beside each of them."""
    numbered = in_order(rows.select(column, tie).where(F.col(column).isNotNull()), column, tie)
    numbered = saved(numbered, "numbered")
    n = numbered.agg(F.count("*").alias("_n"))
    wanted = n.select(F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"), (F.col("_n") - 1).alias("_last"))
    wanted = wanted.withColumn("_at", F.col("share") * F.col("_last")).withColumn("_low", F.floor("_at") + 1).withColumn("_part", F.col("_at") - F.floor("_at"))
    low = numbered.select(F.col("n").alias("_low"), F.col(column).cast("double").alias("_a"))
    high = numbered.select((F.col("n") - 1).alias("_low"), F.col(column).cast("double").alias("_b"))
    marked = low.join(F.broadcast(wanted), "_low").join(high, "_low", "left")  # as many rows as shares
    return marked.select("share", F.when(F.col("_part") == 0, F.col("_a")).otherwise(F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a"))).alias("mark"))
