"""Streaming upserts: restart from the checkpoint, replay, late batches."""

import datetime as dt

from tesserae.session import scratch_path
from tesserae.streaming.upsert import change_sink, compact, merged, run_upserts

SCHEMA = "key string, value string, ts timestamp_ntz, seq long"
T0 = dt.datetime(2024, 1, 1)


def _read(spark, path):
    df = spark.createDataFrame([], SCHEMA)
    rows = merged(spark, path, df.schema, ["key"], ["ts", "seq"]).collect()
    assert len({r["key"] for r in rows}) == len(rows)
    return {r["key"]: r["value"] for r in rows}


def test_restart_processes_only_new_files_and_converges(spark):
    src, ckpt, path = (scratch_path(spark, n) for n in ("stream-src", "stream-ckpt", "stream-out"))
    batches = []

    def sink(df, epoch):
        batches.append(df.count())
        change_sink(path, ["key"], ["ts", "seq"])(df, epoch)

    def stream():
        return spark.readStream.schema(SCHEMA).parquet(src)

    assert _read(spark, path) == {}
    spark.createDataFrame([("a", "1", T0, 1), ("b", "1", T0, 1)], SCHEMA).write.mode("append").parquet(src)
    run_upserts(stream(), sink, ckpt)
    assert _read(spark, path) == {"a": "1", "b": "1"}

    # restart with the same checkpoint after new data arrived
    spark.createDataFrame([("a", "2", T0 + dt.timedelta(hours=1), 1), ("c", "1", T0, 1), ("b", "0", T0, 0)],
                          SCHEMA).write.mode("append").parquet(src)
    run_upserts(stream(), sink, ckpt)
    assert batches == [2, 3]  # the first file is not read again
    assert _read(spark, path) == {"a": "2", "b": "1", "c": "1"}


def test_late_and_replayed_batches_converge(spark):
    path, one = scratch_path(spark, "late"), scratch_path(spark, "late-one")
    sink = change_sink(path, ["key"], ["ts", "seq"])
    first = spark.createDataFrame([("a", "new", T0 + dt.timedelta(hours=2), 1), ("b", "b0", T0, 0)], SCHEMA)
    late = spark.createDataFrame([("a", "old", T0, 9), ("b", "b1", T0, 1), (None, "n", T0, 1)], SCHEMA)
    sink(first, 0)
    sink(late, 1)
    sink(late, 1)  # replay after a failure
    want = {"a": "new", "b": "b1", None: "n"}
    assert _read(spark, path) == want
    compact(spark, path, one, first.schema, ["key"], ["ts", "seq"])
    assert _read(spark, one) == want
