"""Sharding along a Hilbert curve over quantised metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import saved, whole_row


@dataclass(frozen=True)
class Dimension:
    """A metadata column as one axis, cut so that cells hold like numbers of rows and follow the order of the
    values. ``numeric``: at approximate quantiles; otherwise between values, by their exact counts."""

    column: str
    numeric: bool = False


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``axes`` (n x dims, values
    below 2**bits), after Skilling, "Programming the Hilbert curve" (2004)."""
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _value_cuts(rows: DataFrame, column: str, n: int) -> list:
    """The least value of each cell but the first: distinct values in order, each in the cell that the middle of its rows
    falls into, of ``n`` cells of equal numbers of rows. Values are sorted by ranges, and a range's offset is the number of
    rows before it; at most n - 1 values reach the driver."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    placed = saved(counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("p", F.spark_partition_id()), "values")
    begin = placed.groupBy("p").agg(F.sum("c").alias("n"))  # one row per range
    begin = begin.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    upto = F.sum("c").over(Window.partitionBy("p").orderBy("v"))
    middle = placed.join(F.broadcast(begin), "p").select("v", "all", (F.col("before") + upto - F.col("c") / 2).alias("m"))
    cell = F.least(F.floor(F.col("m") * n / F.col("all")), F.lit(n - 1))
    return [r[0] for r in middle.groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).orderBy("cell").select("v").collect()][1:]


def _cells(rows: DataFrame, dims: list[Dimension], bits: int) -> list[Column]:
    """Cell numbers 0 .. 2**bits - 1 of each dimension; a null is in cell 0."""
    n, numeric = 1 << bits, [d for d in dims if d.numeric]
    cuts = {d.column: _value_cuts(rows, d.column, n) for d in dims if not d.numeric}
    if numeric:  # 2**bits - 1 numbers for each dimension reach the driver
        at = [k / n for k in range(1, n)]
        got = rows.agg(*[F.percentile_approx(F.col(f"`{d.column}`").cast("double"), at, 10_000).alias(f"c{k}")
                         for k, d in enumerate(numeric)]).first()
        cuts |= {d.column: sorted(set(got[k] or [])) for k, d in enumerate(numeric)}
    out = []
    for d in dims:
        c = F.col(f"`{d.column}`")
        c = c.cast("double") if d.numeric else c
        above = sum((F.when(c >= F.lit(x), 1).otherwise(0) for x in cuts[d.column]), F.lit(0))
        few = 1 + len(cuts[d.column])  # fewer cells than the curve has are spread over it
        out.append(F.when(c.isNull(), 0).otherwise(F.floor(above * n / few).cast("int")))
    return out


def _shard_rows(rows: DataFrame, dims: list[Dimension], shards: int, bits: int, order: list[str]) -> DataFrame:
    """``rows`` with __shard and __slot: sorted by the curve index, then ``order``,
    and cut into runs whose lengths differ by at most one."""
    if len(dims) * bits > 62:
        raise ValueError("too many dimensions or bits")

    @F.pandas_udf("long")
    def index(cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.array(cells.tolist(), np.int64).reshape(len(cells), len(dims)), bits))

    keyed = rows.withColumn("__curve", index(F.array(*_cells(rows, dims, bits))))
    key = [F.col("__curve"), *[F.col(c).asc_nulls_last() for c in order]]
    # a row's number in its sorted partition is in the low 33 bits, the partition's number above
    run = saved(keyed.repartitionByRange(*key).sortWithinPartitions(*key).withColumn(
        "__n", F.monotonically_increasing_id()), "curve")
    part = F.shiftright("__n", 33)
    # one row per partition: few, whatever the input
    sizes = run.groupBy(part.alias("__p")).agg(F.count("*").alias("c"))
    sizes = sizes.select("__p", (F.sum("c").over(Window.orderBy("__p")) - F.col("c")).alias("__before"),
                         F.sum("c").over(Window.partitionBy(F.lit(0))).alias("__all"))
    # the exact rank and the number of rows settle shard and slot
    rank = F.col("__before") + F.col("__n").bitwiseAND((1 << 33) - 1)
    out = run.withColumn("__p", part).join(F.broadcast(sizes), "__p").withColumn("__rank", rank)
    # shard s begins at rank floor(s * all / shards)
    out = out.withColumn("__shard", F.expr(f"cast((((__rank + 1) * {shards} - 1) div __all) as int)"))
    return out.withColumn("__slot", F.expr(f"__rank - (cast(__shard as long) * __all) div {shards}"))


def shard(docs: DataFrame, dims: list[Dimension], shards: int = 24, bits: int = 4, doc_id: str = "doc_id",
          text: str = "text", keep_rows: bool = True) -> DataFrame:
    """Rows in shards 0 .. shards - 1 along a Hilbert curve over ``dims``; counts
    per shard differ by at most one (law ``rows``).

    Adds size (UTF-8 bytes + 8), text_crc32, law, shard, slot (from 0 in each
    shard) and grown_shard (null under this law), replacing columns of those
    names; with ``keep_rows`` false only doc_id and these are returned.

    Neighbours on the curve are near in every dimension, so a shard spans few
    cells of each and minima / maxima per file prune on any of them (``spans``).
    Cells of text follow the order of its values, so ranges of it prune like ranges of numbers.
    A cell with very many rows is cut inside by id. Ranks are exact: one range
    shuffle, then an offset per partition. Null texts have size 8 and crc32 0;
    null metadata lies in cell 0; null ids come last in their cell; repeated rows
    each take a slot. An empty table gives an empty result.
    """
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        *([whole_row(docs, made)] if keep_rows else []), F.col(doc_id).alias("__id"),
        (F.octet_length(t) + 8).cast("long").alias("__size"), F.crc32(t.cast("binary")).alias("__crc"),
        *[F.col(f"`{d.column}`").alias(f"__d{k}") for k, d in enumerate(dims)])
    own = [Dimension(f"__d{k}", d.numeric) for k, d in enumerate(dims)]
    out = _shard_rows(base, own, shards, bits, ["__id", "__crc"])
    return out.select(
        *(["__row.*"] if keep_rows else [F.col("__id").alias(doc_id)]), F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def spans(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Per shard its rows and the smallest and largest value of each column: what a
    reader needs to skip shards."""
    return sharded.groupBy("shard").agg(
        F.count("*").alias("n_rows"),
        *[f(f"`{c}`").alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet under ``path``, a folder per shard, rows in slot order within each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_where(spark: SparkSession, path: str, span: DataFrame, column: str, low, high) -> DataFrame:
    """Rows whose ``column`` is between ``low`` and ``high``; only shards whose span
    meets that range are listed for reading (at most one number per shard is collected)."""
    hit = [r[0] for r in span.where((F.col(f"max_{column}") >= low) & (F.col(f"min_{column}") <= high)).select("shard").collect()]
    return spark.read.parquet(path).where(F.col("shard").isin(hit) & F.col(f"`{column}`").between(low, high))
