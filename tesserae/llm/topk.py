"""Exact top-k inner-product search with a vector-approximation file.

The file holds one byte for each component: its cell between the least and the greatest
component of all vectors. All score bounds come from it and the queries alone, in blocks; exact
vectors are read by id only for rows whose bounds leave them in question, those of the highest
bounds first, the others only as far as the kth exact score asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import saved

CELLS = 256


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double; null if the vector is
    null or empty or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fine, ints)


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """Rows of equal length as one array of int64."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def approximation(rows: DataFrame) -> DataFrame:
    """(id, dim, low, width, cells) of ``rows`` (id, dim, v): the approximation file. Component x lies in cell c, so
    low + c * width <= x < low + (c + 1) * width; low and width are those of all vectors of its length."""
    ends = rows.groupBy("dim").agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"))
    schema = "id long, dim int, low long, width long, cells binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, dim, v, low, high in zip(*[b.column(k).to_pylist() for k in range(3)], b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                width = (high - low) // CELLS + 1
                if -(1 << 62) < low and high < 1 << 62:
                    cells = ((np.array(v, np.int64) - low) // width).astype(np.uint8).tobytes()
                else:
                    cells = bytes((x - low) // width for x in v)
                out.append((i, dim, low, width, cells))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()], strict=True)],
                    names=["id", "dim", "low", "width", "cells"])

    return rows.join(ends, "dim").select("id", "dim", "v", "low", "high").mapInArrow(run, schema)


def bounds(q: np.ndarray, q_ids: np.ndarray, cells: np.ndarray, ids: np.ndarray, low: int, width: int, k: int) -> Iterator[tuple]:
    """(query id, ids, lower bounds, upper bounds) of the rows of one block that may be among a query's k best, by
    their cells alone: those whose upper bound reaches the kth largest lower bound in the block.

    With cells c, a score lies between q.(low + c * width) + (width - 1) * (sum of the negative parts of q) and the same with
    the positive parts: one product of queries and cells gives all bounds.
    """
    most = max(int(np.abs(q.astype(object)).max()), 1) * q.shape[1]
    # beyond exact doubles, or where scores may pass 64 bits: Python integers
    exact = most * CELLS >= 1 << 52 or most * max(abs(low), abs(low + CELLS * width)) >= 1 << 62
    x = cells.astype(object if exact else np.float64).T
    step = max(1, (1 << 22) // len(cells))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        products = part.astype(x.dtype) @ x
        for i, p in enumerate(products):
            ints = [int(y) for y in part[i]]
            slack = (width - 1) * sum(map(abs, ints))
            base = low * sum(ints) + (width - 1) * sum(y for y in ints if y < 0)
            rows = np.flatnonzero(ids != q_ids[at + i])
            p = p[rows]
            if len(rows) > k and not exact:
                kth = int(np.partition(p, len(p) - k)[-k])
                keep = p >= kth - slack // width  # upper bound at or above the kth lower one, in units of cells
                rows, p = rows[keep], p[keep]
            lower = [base + width * int(y) for y in p]
            upper = [_near(y + slack) for y in lower]
            lower = list(map(_near, lower))
            if len(rows) > k and exact:
                kth = sorted(lower)[-k]
                keep = [j for j, y in enumerate(upper) if y >= kth]
                rows, lower, upper = rows[keep], [lower[j] for j in keep], [upper[j] for j in keep]
            yield int(q_ids[at + i]), ids[rows].tolist(), lower, upper


def _near(x: int) -> int:
    """The nearest 64-bit integer."""
    return max(-(1 << 63), min((1 << 63) - 1, x))


def _scores(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of ``pairs`` (query_id, vec_id): both exact vectors are fetched by id."""
    both = pairs.join(rows.select(F.col("id").alias("vec_id"), F.col("v").alias("x")), "vec_id").join(
        rows.where("q").select(F.col("id").alias("query_id"), F.col("v").alias("y")), "query_id").select("query_id", "vec_id", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                scores.append(_near(sum(map(int.__mul__, x, y))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    return both.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id",
          vector: str = "embedding", block_rows: int = 65_536, block_queries: int = 1_024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest integer inner
    product for each row that ``is_query`` marks, among all rows but its own.

    Method: one row per id; the approximation file, one byte a component; bounds of all scores from it, for blocks of
    about ``block_rows`` cells and ``block_queries`` queries, of which each block hands on only rows that may count;
    over all blocks, rows whose upper bound is below the kth largest lower bound fall away. Exact vectors are then
    joined by id: first for the k highest upper bounds of each query, then for those rows
    whose upper bounds reach the kth exact score. That is certain: no row left out can count.

    Exact, ties to the smaller id. Vectors that are null or empty, hold a null or non-finite component, or have no id take no part (two empty
    vectors would have no components to compare); vectors of different lengths are not compared. Components and scores beyond 64
    bits count as the nearest 64-bit integer. Of rows with one id the smallest vector counts, found by partial aggregation before
    any block is dealt, and the row is a query if any of them is. Fewer than k candidates: all. An empty table, or one
    without queries, gives an empty result. Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    rows = saved(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")).withColumn("dim", F.size("v")), "vectors")
    cells = saved(approximation(rows), "approximation")
    n, n_q = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    deal, deal_q = max(1, -(-n // block_rows)), max(1, -(-n_q // block_queries))
    cb, qb = F.pmod(F.xxhash64("id"), F.lit(deal)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(deal_q)).cast("int")
    every_q, every_c = F.explode(F.expr(f"sequence(0, {deal_q - 1})")), F.explode(F.expr(f"sequence(0, {deal - 1})"))
    sides = cells.select("dim", cb.alias("c"), every_q.alias("b"), "id", "cells", "low", "width").withColumn(
        "v", F.lit(None).cast("array<long>")).unionByName(
        rows.where("q").select("dim", every_c.alias("c"), qb.alias("b"), "id", "v"), allowMissingColumns=True)

    def run(t: pa.Table) -> pa.Table:
        query = np.array(t.column("cells").is_null().to_pylist(), bool)
        out: list[tuple] = []
        if query.any() and not query.all():
            mine, theirs = t.filter(pa.array(query)), t.filter(pa.array(~query))
            data = np.frombuffer(b"".join(theirs.column("cells").to_pylist()), np.uint8).reshape(theirs.num_rows, -1)
            low, width = theirs.column("low")[0].as_py(), int(theirs.column("width")[0].as_py())
            for q, ids, lower, upper in bounds(_matrix(mine.column("v"), mine.num_rows), mine.column("id").to_numpy(), data,
                                               theirs.column("id").to_numpy(), low, width, k):
                out += zip([q] * len(ids), ids, lower, upper, strict=True)
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "lower", "upper"), cols, strict=True)})

    near = saved(sides.groupBy("dim", "c", "b").applyInArrow(run, "query_id long, vec_id long, lower long, upper long"), "bounded")
    by = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    whole = Window.partitionBy("query_id")
    near = near.withColumn("r", by(F.desc("lower"), "vec_id")).withColumn("floor", F.max(F.when(F.col("r") == k, F.col("lower"))).over(whole))
    near = near.where("floor is null or upper >= floor").withColumn("r", by(F.desc("upper"), "vec_id"))
    near = saved(near.select("query_id", "vec_id", "upper", "r"), "in-question")
    first = saved(_scores(near.where(F.col("r") <= k), rows), "scores")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    rest = near.where(F.col("r") > k).join(kth, "query_id").where((F.col("kth").isNull()) | (F.col("upper") >= F.col("kth")))
    every = first.unionByName(_scores(rest.select("query_id", "vec_id"), rows))
    return every.withColumn("rank", by(F.desc("score"), "vec_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
