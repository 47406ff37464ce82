"""Property-graph operators on node and edge DataFrames.

Nodes: one row per node id. Edges: ``src, dst`` rows; an undirected
relationship is stored as two directed rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fast_token
from ..session import scratch_path


def unordered_pairs(df: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Set of unordered pairs: order the two ids, drop self pairs, dedupe."""
    x, y = F.col(a), F.col(b)
    return (df.filter(x.isNotNull() & y.isNotNull() & (x != y))
            .select(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"))
            .distinct())


def ranked_ids(nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """``id`` and its exact ``rank`` from 0 in id order; null ids take no part.

    Ids are sorted by ranges and numbered within each; a range's offset is the number of ids in
    those before it, and only the ranges' counts are added up in one place. The numbered ids are written to the
    shared folder first, so ranks cannot change when a task is run again.
    """
    spark = nodes.sparkSession
    path = scratch_path(spark, "ranks")
    (nodes.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).repartitionByRange("id").sortWithinPartitions("id")
     .select("id", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
     .write.parquet(path))
    placed = spark.read.parquet(path)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    begin = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_begin"))
    return placed.join(F.broadcast(begin), "_part").select("id", (F.col("_begin") + F.col("_at")).alias("rank"))  # one row a range


def sample_pairs(nodes: DataFrame, draws: int | None = None, n: int | None = None, seed: str = "pairs",
                 id_col: str = "id", token: Callable[[Column], Column] = fast_token) -> DataFrame:
    """Random unordered pairs of distinct ids, the same for the same seed: ``draws`` of them (by
    default as many as there are ids), drawn freely and independently, repeated ones once.

    A draw picks two ranks by seeded hashes: any of all, then any of the others, so every pair has the same
    chance. Ranks are joined to ids on executors, spread evenly since draws are; no id reaches the driver. ``n`` keeps
    that many pairs, chosen by hash. Fewer than two ids give no pairs. Ids are distinct.
    """
    ranks = ranked_ids(nodes, id_col)
    total = ranks.agg(F.max("rank")).first()[0]
    if not total:
        return ranks.select(F.col("id").alias("src"), F.col("id").alias("dst")).filter(F.lit(False))
    total += 1

    def draw(which: str, among: int) -> Column:
        return F.pmod(token(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"), F.lit(f":{which}"))), F.lit(among))

    drawn = nodes.sparkSession.range(total if draws is None else draws).select(draw("a", total).alias("a"), draw("b", total - 1).alias("b"))
    other = F.col("b") + (F.col("b") >= F.col("a")).cast("long")  # the rank of its own is passed over
    drawn = drawn.select(F.least("a", other).alias("a"), F.greatest("a", other).alias("b")).distinct()
    one = ranks.select(F.col("rank").alias("a"), F.col("id").alias("src"))
    two = ranks.select(F.col("rank").alias("b"), F.col("id").alias("dst"))
    pairs = drawn.join(one, "a").join(two, "b").select("src", "dst")  # lower rank, lower id
    if n is None:
        return pairs
    return pairs.orderBy(token(F.concat_ws(":", F.lit(seed), "src", "dst")), "src", "dst").limit(n)


def symmetric_closure(pairs: DataFrame, normalized: bool = False) -> DataFrame:
    """Both directions of every pair, without duplicates; other columns come along.

    One pass over ``pairs`` (each row explodes into its two directions).
    ``normalized=True`` says the input is already a set of ``src < dst``
    pairs (as ``unordered_pairs`` makes): the two directions can then never
    collide, so no dedupe shuffle is needed.
    """
    more = [c for c in pairs.columns if c not in ("src", "dst")]
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )).alias("e"), *more).select("e.src", "e.dst", *more)
    return both if normalized else both.distinct()


def node_ids(nodes: DataFrame, pred=None) -> DataFrame:
    """``MATCH (p:Label) RETURN p.id``."""
    n = nodes if pred is None else nodes.filter(pred)
    return n.select("id")


def resolve_pairs(pairs: DataFrame, nodes: DataFrame, props: Sequence[str] = ("name",)) -> DataFrame:
    """Match both ends of each pair to a node; unknown ends drop the pair
    (two inner equi joins, AQE picks broadcast or sort-merge)."""
    a = nodes.select(F.col("id").alias("src"), *[F.col(p).alias(f"src_{p}") for p in props])
    b = nodes.select(F.col("id").alias("dst"), *[F.col(p).alias(f"dst_{p}") for p in props])
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", *[f"src_{p}" for p in props],
                                                      *[f"dst_{p}" for p in props])


def merge_nodes(current: DataFrame, incoming: DataFrame, set_cols: Sequence[str], key: str = "id") -> DataFrame:
    """``MERGE (n {id}) SET n.a = .., n.b = ..`` for a batch of rows.

    Match-or-create by key, then the SET columns take the incoming value on
    both branches; other current columns are kept, and are null on created
    nodes. ``incoming`` holds one row per key.

    One full outer join on the key, at every size.
    """
    inc = incoming.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_in_{c}") for c in set_cols])
    j = current.join(inc, current[key] == inc["_k"], "full_outer")
    out = []
    for c in current.columns:
        if c == key:
            out.append(F.coalesce(F.col(key), F.col("_k")).alias(key))
        elif c in set_cols:
            out.append(F.when(F.col("_k").isNotNull(), F.col(f"_in_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    for c in set_cols:
        if c not in current.columns:
            out.append(F.col(f"_in_{c}").alias(c))
    return j.select(*out)


def merge_edges(existing: DataFrame, pairs: DataFrame, both_ways: bool = False) -> DataFrame:
    """``MERGE (a)-[:r]->(b) MERGE (b)-[:r]->(a)``: add both directions of
    each pair unless already present; nothing is added twice.

    The batch alone is deduplicated; an anti join against the stored edges
    leaves the new ones, which are appended. Stored edges are a set by
    contract and are kept as they are. ``both_ways`` says that every stored edge has its
    reverse stored too: unordered pairs are then matched once instead of two directions, half the rows.
    """
    cur = existing.select("src", "dst")
    if both_ways:
        new = unordered_pairs(pairs).join(cur.filter(F.col("src") < F.col("dst")), ["src", "dst"], "left_anti")
        return cur.unionByName(symmetric_closure(new, normalized=True))
    new = symmetric_closure(pairs, normalized=True).distinct()
    return cur.unionByName(new.join(cur, ["src", "dst"], "left_anti"))


def detach_delete(nodes: DataFrame, edges: DataFrame, doomed: DataFrame, key: str = "id"):
    """``DETACH DELETE``: drop the nodes and every edge touching them.
    Returns ``(nodes, edges)``."""
    # an anti join ignores duplicates on its right side: no dedupe shuffle
    d = doomed.select(F.col(key).alias("_d"))
    n = nodes.join(d, F.col(key) == F.col("_d"), "left_anti")
    e = (edges.join(d.withColumnRenamed("_d", "_ds"), F.col("src") == F.col("_ds"), "left_anti")
         .join(d.withColumnRenamed("_d", "_dd"), F.col("dst") == F.col("_dd"), "left_anti"))
    return n, e


def detach_delete_stored(edges: DataFrame, doomed: DataFrame, key: str = "id") -> DataFrame:
    """The edges that ``DETACH DELETE`` of ``doomed`` leaves, of a table of edges stored both ways and bucketed by
    (src, dst) (``catalog.write_keyed(by="primary")``).

    A doomed end is sought on one side only: an edge that ends in a doomed node is the reverse of one that begins
    there. That is the one shuffle of the edges, by ``src``, in which a hub is a skewed key that can be split. The edges found, in
    both directions, then meet the table bucket by bucket, where a hub's edges are spread evenly and nothing
    but those few edges moves.
    """
    touched = edges.join(doomed.select(F.col(key).alias("_d")), F.col("src") == F.col("_d"), "left_semi").select("src", "dst")
    return edges.join(symmetric_closure(touched, normalized=True), ["src", "dst"], "left_anti")


def delete_edges(edges: DataFrame, doomed: DataFrame) -> DataFrame:
    """``MATCH ()-[r]->() DELETE r`` for the given (src, dst) rows."""
    return edges.join(doomed.select("src", "dst"), ["src", "dst"], "left_anti")
