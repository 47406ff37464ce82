"""Deterministic stand-ins for the data each store holds, derived from the
driver tables so every view grows with them (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import iso_text
from .tables import read_table

# Tag vocabulary of the document collection, in order.
TAG_WORDS = ["work", "home", "sport", "music", "travel", "food", "news"]


def _s(c: Column) -> Column:
    return c.cast("string")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat people table: one row per order."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        _s(k).alias("id"),
        F.concat(F.lit("w"), _s(k % 3)).alias("worker"),
        F.col("o_orderdate").alias("timestamp"),
        F.concat(F.lit("first"), _s(F.col("o_custkey") % 50)).alias("first_name"),
        F.concat(F.lit("last"), _s(F.col("o_custkey") % 97)).alias("last_name"),
        F.concat(F.lit("u"), _s(k), F.lit("@example.org")).alias("email"),
        F.concat(F.lit("555-"), _s(k)).alias("phone"),
        F.col("o_totalprice").alias("amount"),
    )


def user_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide-column table keyed by (city, user_id): one row per order."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(
        F.col("n_name").alias("city"),
        F.col("o_orderkey").alias("user_id"),
        F.col("c_name").alias("username"),
        (F.lit(1) + (F.col("o_orderkey") * 7919) % 3600).cast("int").alias("session_duration"),
        F.col("o_orderdate").alias("last_access"),
    )


def users_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar part of the document collection: one document per customer."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("_id"),
        F.when(k % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"),
        F.concat(F.lit("user"), _s(k), F.lit("@example.org")).alias("email"),
        F.col("c_mktsegment").alias("job"),
        F.col("n_name").alias("company"),
        ((k * 37) % 181 - 90).cast("double").alias("lat"),
        ((k * 53) % 361 - 180).cast("double").alias("lng"),
        (F.lit(1) + (k * 7919) % 1000).cast("int").alias("login_count"),
        iso_text(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                 + F.make_dt_interval(secs=((k * 7919) % 31536000).cast("int"))).alias("last_login"),
        (k % 4 != 0).alias("active"),
    )


def tags_expr(id_col: str = "_id") -> Column:
    """2 to 5 words per document, picked by arithmetic on the id."""
    words = F.array(*[F.lit(w) for w in TAG_WORDS])
    k = F.col(id_col)
    return F.transform(
        F.sequence(F.lit(1), (F.lit(2) + k % 4).cast("int")),
        lambda i: F.element_at(words, ((k * i * 3 + i) % len(TAG_WORDS) + 1).cast("int")),
    )


def users(spark: SparkSession, sf_dir: str, nested: bool = True) -> DataFrame:
    """Document collection; nested form has ``profile{job, company, location{lat, lng}}``."""
    f = users_flat(spark, sf_dir).withColumn("tags", tags_expr())
    if not nested:
        return f
    return f.select(
        "_id", "name", "email",
        F.struct("job", "company", F.struct("lat", "lng").alias("location")).alias("profile"),
        "tags", "login_count", "last_login", "active",
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes, one per part; ``joined_iso`` is the text ``to_date`` parses."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("p"), _s(k), F.lit("@example.org")).alias("email"),
        F.col("p_type").alias("job"),
        F.col("p_brand").alias("city"),
        F.concat(_s(2020 + k % 5), F.lit("-0"), _s(1 + k % 9), F.lit("-1"), _s(k % 10)).alias("joined_iso"),
    )


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate node pairs: every line's part with its order's lowest part.

    One pair per line item (a star per order, not all pairs in an order), so
    output is linear in lineitem. The per-order minimum is a partial+final
    hash aggregate and the join back is N:1 on the order key, so a hot order
    is pre-aggregated map-side and split by AQE on the join.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    anchor = li.groupBy("l_orderkey").agg(F.min("l_partkey").alias("anchor"))
    return li.join(anchor, "l_orderkey").select(F.col("l_partkey").alias("a"), F.col("anchor").alias("b"),
                                                F.col("l_shipdate").alias("shipdate"))


def pairs_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs (src < dst), each once, with ``since``, the ship date of the first line that has it. Pairs of
    an earlier load are those with ``since`` before its date; both loads share this one aggregate."""
    r = raw_pairs(spark, sf_dir).filter(F.col("a") != F.col("b"))
    return r.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("shipdate").alias("since"))


def pairs(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """Unordered pairs (src < dst), deduplicated; ``before`` keeps only pairs
    seen in lines shipped before that date (an earlier load)."""
    if before is not None:
        return pairs_seen(spark, sf_dir).filter(F.col("since") < F.lit(before).cast("timestamp_ntz")).select("src", "dst")
    from ..operators.graph import unordered_pairs
    return unordered_pairs(raw_pairs(spark, sf_dir), "a", "b")


def edges(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """``pairs`` stored both ways."""
    from ..operators.graph import symmetric_closure
    return symmetric_closure(pairs(spark, sf_dir, before), normalized=True)


def metric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change stream for ``user_metrics``: every line item rewrites its
    order's row (several writes per key, ordered by ship date then line)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    um = user_metrics(spark, sf_dir).select("city", "user_id", "username")
    return li.join(um, li.l_orderkey == um.user_id).select(
        "city", "user_id", "username",
        (F.lit(1) + (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("l_partkey")) % 3600)
        .cast("int").alias("session_duration"),
        F.col("l_shipdate").alias("last_access"),
        F.col("l_linenumber").cast("long").alias("seq"),
    )


def kv_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One store node per nation; odd ones are replicas."""
    n = read_table(spark, sf_dir, "nation").select("n_nationkey")
    return n.select(F.col("n_nationkey").alias("node"),
                    F.when(F.col("n_nationkey") % 2 == 0, F.lit("master")).otherwise(F.lit("slave")).alias("role"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command log, one entry per event (five commands); only replicas serve."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return e.select(
        "event_id",
        F.concat(F.lit("k"), _s(F.col("event_id") % 6)).alias("key"),
        (F.lit(1) + 2 * (F.col("event_id") % 12)).cast("int").alias("node"),
        F.col("event_type").alias("cmd"),
        "ts",
    )


def kv_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET stream with repeated keys; (ts, seq) orders writes of one key."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return e.select(
        F.concat(F.lit("u"), _s(F.col("user_id"))).alias("key"),
        _s(F.col("event_id")).alias("value"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def kv_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys asked for by GET: one per customer; many are never written."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey")
    return c.select(F.concat(F.lit("u"), _s(F.col("c_custkey"))).alias("key"))
