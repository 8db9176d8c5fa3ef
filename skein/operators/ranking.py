"""Ranks and running sums over a whole table without a window that has one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import Written


def _placed(df: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """The table range-partitioned by ``by`` and written, with the number of each row's range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id())
    return Written(df.sparkSession, "ranked").table(ranged, "placed"), parts


def running(df: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before, in the order of the columns ``by`` (which should be unique).

    Only one sum for each range is collected; a range is one shuffle partition.
    """
    placed, _ = _placed(df.withColumn("_v", value), by)
    sums = sorted((r._range, r.s or 0) for r in placed.groupBy("_range").agg(F.sum("_v").alias("s")).collect())
    before, at = [], 0
    for part, s in sums:
        before.append((part, at))
        at += s
    table = df.sparkSession.createDataFrame(before or [(0, 0)], "_range int, _before bigint")
    w = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    got = placed.join(F.broadcast(table), "_range")  # a row a partition
    return got.withColumn(name, F.col("_before") + F.coalesce(F.sum("_v").over(w), F.lit(0))).drop("_range", "_v", "_before")


def ranked(df: DataFrame, by: list[str], name: str = "rn") -> DataFrame:
    """``name``: the place of each row, from 1, in the order of the columns ``by``."""
    return running(df, by, F.lit(1).cast("bigint"), name).withColumn(name, F.col(name) + 1)
