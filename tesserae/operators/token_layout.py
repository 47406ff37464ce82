"""Keyed tables stored in token order, read by seeks and pages that touch few row groups.

The token of the partition key is a stored column and the rows are sorted by it, so
the minima and maxima that Parquet keeps for row groups and pages answer a range of tokens. A
small table beside the rows holds the first and last position of each block of rows; it bounds a page from
above before the rows are read, so both ends of the range reach the scan, down to the
clustering columns: a page inside a partition key that holds a third of all rows is as cheap as any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import fast_token
from ..schemas import KeySpec
from .keyed import Token, with_token

TOKEN = "token"


def _order(key: KeySpec) -> list[str]:
    return [TOKEN, *key.primary]


def write_by_token(df: DataFrame, path: str, key: KeySpec, token: Token = fast_token, row_group_bytes: int | None = None,
                   block_rows: int = 1 << 20) -> str:
    """Store ``df`` at ``path`` sorted by (token, key), with the column ``token``, and the ends of its
    blocks of ``block_rows`` rows (a file's last one is shorter) at ``path``-ends.

    Ranges of (token, key) are dealt to the tasks, so a partition key that holds a third of all
    rows is split over many files by its clustering columns. Key columns are not null.
    """
    order = _order(key)
    rows = with_token(df, key.partition, TOKEN, token).repartitionByRange(*order).sortWithinPartitions(*order).write
    if row_group_bytes:
        rows = rows.option("parquet.block.size", row_group_bytes)
    rows.parquet(path)
    spark = df.sparkSession
    at = F.struct(*order)
    block = F.floor(F.col("_metadata.row_index") / block_rows)
    ends = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file"), block.alias("block")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("rows"))
    ends.write.parquet(f"{path}-ends")
    return path


def _past(order: Sequence[str], position: Sequence, equal: bool, below: bool) -> Column:
    """Whether a row lies after ``position`` in the order (``below``: before it), or at it if ``equal``; spelt out by
    columns, so that the scan can use it."""
    cond = F.lit(equal)
    for c, v in reversed(list(zip(order, position))):
        v = F.lit(v)
        cond = (F.col(c) < v if below else F.col(c) > v) | ((F.col(c) == v) & cond)
    return cond


def _last_position(ends: DataFrame, limit: int) -> tuple | None:
    """Position up to which ``limit`` rows surely lie, from blocks in order; the first may be used in part.
    One row per block is ranked, and one position comes back."""
    w = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sure = (F.sum("rows").over(w) - F.first("rows").over(w)).alias("sure")
    r = ends.select("last", sure).agg(F.min(F.when(F.col("sure") >= limit, F.col("last"))).alias("enough"), F.max("last").alias("all")).first()
    last = r["all"] if r["enough"] is None else r["enough"]
    return None if last is None else tuple(last)


def page(spark: SparkSession, path: str, key: KeySpec, limit: int, after: Sequence | None = None,
         start: int | None = None) -> DataFrame:
    """The next ``limit`` rows in token order, with their ``token``: from the beginning, from the first token
    at or after ``start``, or after the position ``after`` (token and key of the last row of the page before).

    Both ends of the range read are filters of the scan, so it reads only the row groups of about one page.
    """
    order, ends = _order(key), spark.read.parquet(f"{path}-ends")
    rows = spark.read.parquet(path)
    if after is not None:
        if len(after) != len(order):
            raise ValueError(f"a position has {len(order)} values: {order}")
        types = dict(rows.dtypes)
        ends = ends.filter(F.col("last") > F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, after)]))
        rows = rows.filter((F.col(TOKEN) >= F.lit(after[0])) & _past(order, after, equal=False, below=False))
    elif start is not None:
        ends = ends.filter(F.col(f"last.{TOKEN}") >= start)
        rows = rows.filter(F.col(TOKEN) >= F.lit(start))
    last = _last_position(ends, limit)
    if last is None:
        return rows.filter(F.lit(False))
    rows = rows.filter((F.col(TOKEN) <= F.lit(last[0])) & _past(order, last, equal=True, below=True))
    return rows.orderBy(*order).limit(limit)


def seek(spark: SparkSession, path: str, key: KeySpec, start: int) -> DataFrame:
    """``WHERE token(pk) >= start LIMIT 1``; wraps to the smallest token where nothing lies at or after ``start``."""
    past = spark.read.parquet(f"{path}-ends").agg(F.max(f"last.{TOKEN}").alias("t")).first()["t"]
    return page(spark, path, key, 1, start=start if past is not None and past >= start else None)
