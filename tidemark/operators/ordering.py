"""Distributed total orders.

``row_number()`` over an unpartitioned window pulls every row into one task.
A global position is instead built from one range-partitioned sort that is
stored: each row's index inside its sorted partition plus the row count of all
earlier partitions. Rows, counts and offsets are all read from that one stored
table. Sorting twice would not do: the bounds of a range partitioning come from
a sample of its own input, so two sorts of one table may cut it differently.
The counts table has one row per partition, so its broadcast is bounded by the
partition count, not the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import stored


def global_positions(df: DataFrame, order: list[Column], out: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row under ``order``.

    ``order`` must be a total order (end it with a unique key). The sorted rows
    are written once.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pid = F.spark_partition_id()
    local = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    ranked = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"__pid": pid, "__local": local}))
    counts = ranked.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    offsets = counts.select(
        "__pid",
        (F.sum("__cnt").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))).alias("__off"),
    )
    joined = ranked.join(F.broadcast(offsets), "__pid")
    return joined.withColumn(out, F.coalesce(F.col("__off"), F.lit(0)) + F.col("__local") + 1).drop("__pid", "__local", "__off")


def top_page(df: DataFrame, order: list[Column], page: int, page_size: int, out: str = "pos") -> tuple[DataFrame, int, int]:
    """Rows of one page under ``order`` with the page clamped to 1..pages.

    The page is a range of stored positions, so a late page costs what an early
    one does and only the scalar row count reaches the driver.
    """
    ranked = global_positions(df, order, out)
    total = ranked.count()
    pages = max(1, -(-total // page_size))
    eff = min(max(page, 1), pages)
    lo = (eff - 1) * page_size
    return ranked.where(F.col(out).between(lo + 1, lo + page_size)), eff, pages
