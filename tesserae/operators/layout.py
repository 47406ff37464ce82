"""Partition layout reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def partitions_for(spark: SparkSession, floor: int = 10) -> int:
    """Partition count for a repartition: 10 at small
    scale, the session's sized shuffle partition count beyond it."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partition_stats(df: DataFrame, by: Sequence[str] = ("worker",)) -> DataFrame:
    """Row count per (label, partition id), sorted."""
    p = df.withColumn("partition_id", F.spark_partition_id())
    return (p.groupBy(*by, "partition_id").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(*by, "partition_id"))


def skew_report(df: DataFrame) -> DataFrame:
    """One row: partitions, rows, min/max/avg rows per partition and the
    max/avg ratio (1.0 = perfectly even)."""
    per = df.groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("partitions"),
        F.sum("n").alias("rows"),
        F.min("n").alias("min_rows"),
        F.max("n").alias("max_rows"),
        F.avg("n").alias("avg_rows"),
    ).withColumn("skew", F.col("max_rows") / F.col("avg_rows"))


def order_faults(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per ``by``: rows, and how many come before their left neighbour of the same
    partition in the order of ``keys`` (0 everywhere: sorted inside partitions).

    Neighbours are compared within physical partitions, so no task sees more
    than the partition it already had.
    """
    p = df.select(*[F.col(c) for c in dict.fromkeys([*by, *keys])],
                  F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_pos"))
    w = Window.partitionBy("_pid").orderBy("_pos")
    left = F.lag(F.struct(*keys)).over(w)
    fault = F.coalesce(F.struct(*keys) < left, F.lit(False))
    return (p.select(*by, fault.alias("_fault")).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_fault")).alias("out_of_order")))
