"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import saved


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))).first()
    return r[0], r[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected ``links``; root is the
    smallest node reachable.

    Each round is two aggregations to the smallest neighbour and two equi joins;
    its edges are written to the shared folder, so lineage stays short and a lost
    executor costs one round. So are the smallest neighbours: the join's other side is then a plain shuffle of
    edges, and a node of very many (the root of a large component) is a skewed key that can be split. Rounds grow with the logarithm of the longest path.
    Only counts reach the driver. Loops and repeated links do no harm; null ends
    are no links; an empty input gives an empty result.
    """
    edges = saved(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a <> b").distinct(), "large")
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = saved(small.where("a <> b").distinct(), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select("b", "b").distinct())
