"""Global order without a task that gets all rows, and partitions that keep their size."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graphs import cut


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """df in ranges of its order, with _part, the number of each range; ranges follow the rows, however sparse their keys are.

    The ranges are drawn from a sample, which another run might draw otherwise, so they are kept in a checkpoint.
    """
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def carried(held: DataFrame, total: Column, combine) -> DataFrame:
    """held with _before: combine (a window aggregate of a column's name) of the totals of all ranges before; null in the first."""
    parts = held.groupBy("_part").agg(total.alias("_total"))
    before = combine("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return held.join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part")  # a row a range


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """As many partitions as leave each about each rows, so that a task's memory stays the same however many there are."""
    return max(spark.sparkContext.defaultParallelism, ceil(rows / each))
