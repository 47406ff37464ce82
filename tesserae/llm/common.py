"""Shared helpers: input tables, the shared scratch folder, carrying whole rows, fixed-size bitmaps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ID = 9223372036854775807
#: Bits of a bitmap in one row on its way to the driver, as a power of two; tasks that send such rows, one after another.
BLOCK_BITS, PARTS = 18, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, deleted when the
    application ends. Where the setting is absent, a local master gets a
    private folder; a cluster is refused, because its executors share none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tesserae-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs start
    from the files, so nothing upstream is computed again or lost with an executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame, made: tuple[str, ...] = ()) -> Column:
    """All columns of ``df`` as one struct ``__row``, so that operators' working
    columns cannot clash with the caller's. Columns named like one that the
    operator makes (``made``, any case) are left out: the operator's replaces them."""
    taken = {m.lower() for m in made}
    cols = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in taken]
    return F.struct(*cols).alias("__row")


def id_order(col: str | Column) -> Column:
    """Null ids come after every other id."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(MAX_ID))


def bitmap(hashes: DataFrame, col: str, bits: int) -> bytearray:
    """A bitmap of 2**bits bits with the bits of all ``col`` (long hashes) set.
    Its size is fixed by ``bits``, whatever the number of rows. Tasks pack it into blocks of
    2**BLOCK_BITS bits; the driver holds it once, and besides it the blocks of one of PARTS tasks."""
    block = min(bits, BLOCK_BITS) - 6  # in words of 64 bits, as a power of two
    h = F.col(col).bitwiseAND((1 << bits) - 1)
    words = hashes.select(F.shiftright(h, 6).alias("w"), F.expr(f"shiftleft(1L, cast(`{col}` & 63 as int))").alias("b")).groupBy(
        "w").agg(F.bit_or("b").alias("b"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            w, x = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.argsort(w >> block, kind="stable")
            w, x = w[order], x[order]
            cuts = [0, *(np.flatnonzero(np.diff(w >> block)) + 1).tolist(), len(w)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    blocks.setdefault(int(w[i] >> block), np.zeros(1 << block, np.int64))[w[i:j] & ((1 << block) - 1)] = x[i:j]
        for k, x in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["block", "bits"])

    out, size = bytearray(1 << (bits - 3)), 8 << block
    for r in words.repartition(F.shiftright("w", block)).mapInArrow(pack, "block long, bits binary").coalesce(PARTS).toLocalIterator():
        out[r["block"] * size : (r["block"] + 1) * size] = r["bits"]
    return out


def in_bitmap(spark: SparkSession, data: bytes | bytearray | Broadcast, col: Column) -> Column:
    """Whether the long hash's bit is set in a bitmap (or a broadcast one): false means certainly not a member."""
    shared = data if isinstance(data, Broadcast) else spark.sparkContext.broadcast(data)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        words = np.frombuffer(shared.value, dtype=np.uint64)
        x = h.to_numpy(dtype=np.int64).astype(np.uint64) & np.uint64(len(words) * 64 - 1)
        return pd.Series((words[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1)

    return test(col)
