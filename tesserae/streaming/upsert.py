"""Keyed last-write-wins upserts fed by a stream.

``foreachBatch`` reduces each micro-batch to one row per key and writes it to its
own ``epoch=<n>`` folder; reading ranks all of them by the version columns. A batch
costs what it holds (nothing already written is read or rewritten), a batch replayed
after a failure overwrites its own folder with the same rows, and late or
reordered batches converge to the same table. ``compact`` folds the folders into one.

The stream checkpoint and the folders lie under the shared folder, so a restarted
query goes on from its offsets after the loss of executors or the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keyed import upsert
from ..session import scratch_path
from ..sources.tables import read_table, table_path


def change_sink(path: str, key: Sequence[str], version: Sequence[str]):
    """A ``foreachBatch`` function writing each batch's latest row per key."""

    def write(batch: DataFrame, epoch_id: int) -> None:
        latest = upsert(None, batch, key, version, batch_precedence=False)
        latest.write.mode("overwrite").parquet(f"{path}/epoch={int(epoch_id)}")

    return write


def run_upserts(stream: DataFrame, sink, checkpoint: str) -> None:
    """Drain everything available now through ``sink``, then stop."""
    q = (stream.writeStream.foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def merged(spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The table after all batches written to ``path`` (none yet: empty)."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/epoch=-1")
    changes = spark.read.schema(schema).parquet(path).select(*schema.names)
    return upsert(None, changes, key, version, batch_precedence=False)


def compact(spark: SparkSession, path: str, target: str, schema: T.StructType, key: Sequence[str],
            version: Sequence[str]) -> None:
    """Write the merged table as the only folder of ``target``, a new path."""
    merged(spark, path, schema, key, version).write.mode("errorifexists").parquet(f"{target}/epoch=-1")


def stream_kv_writes(spark: SparkSession, sf_dir: str, compacted: bool = False) -> DataFrame:
    """SET stream over the events files: the store after all writes, ranked on read, or ``compacted`` before."""
    schema = read_table(spark, sf_dir, "events").schema
    # the table is one file or a folder of part files; all files there are form one batch
    src = spark.readStream.schema(schema).parquet(table_path(sf_dir, "events") + "*")
    writes = src.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"),
        F.col("event_id").cast("string").alias("value"),
        "ts",
        F.col("event_id").alias("seq"),
    )
    path = scratch_path(spark, "kv-changes")
    run_upserts(writes, change_sink(path, ["key"], ["ts", "seq"]), scratch_path(spark, "kv-stream-ckpt"))
    if compacted:
        target = scratch_path(spark, "kv-compacted")
        compact(spark, path, target, writes.schema, ["key"], ["ts", "seq"])
        return spark.read.schema(writes.schema).parquet(f"{target}/epoch=-1").select("key", "value")
    return merged(spark, path, writes.schema, ["key"], ["ts", "seq"]).select("key", "value")
