"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.model import scratch


def numbered(df: DataFrame, order: list[Column], name: str = "rank", buckets: int | None = None) -> DataFrame:
    """df with 1, 2, 3, ... in a total order.

    Rows go to range partitions, in which they are sorted and numbered as they are written, once: their bounds are
    sampled, so a second evaluation could draw others. The offsets are sums over one row per partition.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(df.sparkSession, "ranges")
    # the number is made behind the sort: partition * 2^33 + place in it
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()).write.parquet(path)
    m = F.col("__m")
    placed = df.sparkSession.read.parquet(path).withColumn("__p", F.shiftrightunsigned(m, 33)).withColumn("__r", m.bitwiseAND((1 << 33) - 1) + 1).drop("__m")
    counts = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    return placed.join(F.broadcast(before), "__p").withColumn(name, (F.col("__r") + F.col("__before")).cast("long")).drop("__p", "__r", "__before")
