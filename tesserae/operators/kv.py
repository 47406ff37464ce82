"""Key-value operators: SET (last write wins), GET, flush and per-node command
statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import upsert


def kv_set(store: DataFrame | None, writes: DataFrame, version=("ts", "seq")) -> DataFrame:
    """Apply a stream of SETs: the latest (ts, seq) per key wins; keys not
    written keep their value. Returns ``key, value``."""
    w = writes.select("key", "value", *version)
    cur = None
    if store is not None:
        cur = store.select("key", "value")
        for v in version:
            cur = cur.withColumn(v, F.lit(None).cast(w.schema[v].dataType))
    return upsert(cur, w, ["key"], version).select("key", "value")


def kv_get(store: DataFrame, requests: DataFrame) -> DataFrame:
    """GET for every requested key; a missing key returns null (nil).

    A plain equi left join; Spark broadcasts a side that is small at run time.
    """
    return requests.select("key").join(store.select("key", "value"), "key", "left")


def kv_flush(store: DataFrame) -> DataFrame:
    """FLUSHALL: an empty store with the same schema."""
    return store.filter(F.lit(False))


def flush_counts(store: DataFrame) -> DataFrame:
    """One row: keys before a flush and keys left after it."""
    before = store.select(F.lit(1).alias("before"), F.lit(0).alias("after"))
    after = kv_flush(store).select(F.lit(0).alias("before"), F.lit(1).alias("after"))
    return before.unionByName(after).agg(
        F.count_if(F.col("before") == 1).alias("keys_before"), F.count_if(F.col("after") == 1).alias("keys_after"))


def node_stats(nodes: DataFrame, log: DataFrame, cmd: str = "get", since=None, ts_col: str = "ts") -> DataFrame:
    """Calls of ``cmd`` per node with role; nodes that served nothing show 0.
    ``since`` counts only entries at or after that time (a statistics reset).

    The log is aggregated per node first (partial + final hash aggregate), so
    the left join only meets one row per node.
    """
    cond = F.col("cmd") == cmd
    if since is not None:
        cond = cond & (F.col(ts_col) >= F.lit(since).cast("timestamp_ntz"))
    calls = log.filter(cond).groupBy("node").agg(F.count(F.lit(1)).alias("calls"))
    return (nodes.join(calls, "node", "left")
            .select("node", "role", F.coalesce(F.col("calls"), F.lit(0)).cast("long").alias("calls"))
            .withColumn("handled", F.col("calls") > 0))


def command_stats(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Per node: role and a ``map<cmd, calls>`` of every command it served
    (empty map for idle nodes), the shape of a store's command statistics.
    Counts are aggregated per (node, cmd) first; each node's map then holds
    one entry per distinct command, a group bounded by the command set.
    ``calls_of(stats, "get")`` reads one command with a 0 default."""
    per = log.groupBy("node", "cmd").agg(F.count(F.lit(1)).alias("calls"))
    m = per.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("cmd", "calls"))).alias("stats"))
    return (nodes.join(m, "node", "left")
            .select("node", "role", F.coalesce(F.col("stats"), F.create_map().cast("map<string,bigint>")).alias("stats")))


def calls_of(stats_col: str, cmd: str):
    """``stats.get(cmd, {}).get("calls", 0)``."""
    return F.coalesce(F.try_element_at(F.col(stats_col), F.lit(cmd)), F.lit(0)).cast("long")
