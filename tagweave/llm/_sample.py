"""A bounded sample of each class's ids, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLACK = 3
_RANGE = 1 << 30


def least_hashes(rows: DataFrame, of: str, name: str, n: int) -> DataFrame:
    """rows (of, name) -> at most n distinct names of each class, those with the least hashes. Null classes have none.

    A class's distinct names are counted first (approximately), and names beyond SLACK times the hash range that n of
    them fill are left out before anything is ordered: what one task orders follows n, not the class.
    """
    known = rows.where(F.col(of).isNotNull() & F.col(name).isNotNull()).withColumn("_h", F.pmod(F.xxhash64(name), F.lit(_RANGE)))
    size = known.groupBy(of).agg(F.approx_count_distinct(name).alias("_of"))
    near = known.join(F.broadcast(size), of).where(F.col("_h") <= F.lit(float(_RANGE) * SLACK * n) / F.col("_of"))
    order = Window.partitionBy(of).orderBy("_h", name)
    return near.select(of, name, "_h").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select(of, name)
