"""Rows with a time to live, stored in one folder for each day of expiry.

A purge drops the folders of days gone by, whatever they hold; no row is read or
written. Readers leave such folders out by partition pruning and filter rows only
within what is left.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed import live

DAY = "expiry_day"


def write_by_expiry(df: DataFrame, path: str, key: Sequence[str], expires: str = "expires_at") -> str:
    """Store ``df`` by its day of expiry; rows that never expire (null) have a folder of their own.
    Ranges of (day, key) are dealt to the tasks, so a day that holds most rows is split over many files."""
    (df.withColumn(DAY, F.to_date(expires)).repartitionByRange(DAY, *key).sortWithinPartitions(DAY, *key)
     .write.partitionBy(DAY).parquet(path))
    return path



def read_live(spark: SparkSession, path: str, as_of: str, expires: str = "expires_at") -> DataFrame:
    """Rows alive at ``as_of``: no expiry, or a later one. Folders of earlier days are not listed."""
    df = spark.read.parquet(path)
    day = F.lit(as_of).cast("timestamp_ntz").cast("date")
    return live(df.filter(F.col(DAY).isNull() | (F.col(DAY) >= day)), as_of, expires).drop(DAY)


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Every stored row, expired ones that no purge has dropped yet included."""
    return spark.read.parquet(path).drop(DAY)


def purge(spark: SparkSession, path: str, as_of: str) -> list[str]:
    """Drop the folders of days before that of ``as_of``, all of whose rows have expired, and return those days.
    Rows of that day itself stay until a later purge; ``read_live`` hides those that have expired."""
    today = dt.datetime.fromisoformat(as_of).date().isoformat()
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in store.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{DAY}=") and len(name) == len(DAY) + 11 and name[len(DAY) + 1:] < today:
            store.delete(status.getPath(), True)
            gone.append(name[len(DAY) + 1:])
    return sorted(gone)
