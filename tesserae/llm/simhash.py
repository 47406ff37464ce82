"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint is cut into 16 segments of 4 bits on a ring. If two
fingerprints differ in at most 3 bits, then for some starting segment every chain
of l consecutive segments from there has at most floor(3 l / 16) differing bits:
the first 5 segments agree, the first 10 differ in at most 1 bit, the first 15 in
at most 2. Candidates share the first 5 segments and one half of the next 5 (30
bits), which the budget of 1 over 10 segments makes certain; the rest of the chain
is checked before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import MAX_ID, id_order, saved, whole_row
from tesserae.llm.components import components
from tesserae.llm.words import flat, starts_of

SEGMENT_BITS, SEGMENTS = 4, 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _shingle_hashes(words: list[bytes], k: int, seed: int) -> np.ndarray:
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    buf, digest = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    pairs = zip((end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)
    return np.array([digest(buf[i:j], seed) for i, j in pairs], np.uint64)


def fingerprint(words: list[bytes], k: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word k-shingles; 0 without words."""
    h = _shingle_hashes(words, k, seed)
    if not len(h):
        return 0
    # how often each of the 8 bytes of a hash has each of its 256 values, then bits by value
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.int64) * 256).ravel(), minlength=2048)
    ones = (seen.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, th, fp): A-Z lower-cased, words split at ASCII white space; th is the
    XXH64 of the text. Null text: no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                words, counts = flat(part.column(2).to_pylist(), lower=True)
                fp = [fingerprint(words[s : s + n], k, seed) for s, n in zip(starts_of(counts).tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp, pa.int64())], names=["doc_id", "th", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), _text_hash(F.col(text)).alias("th"),
                       F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, th long, fp long")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _turned(x: str, start: int) -> str:
    """SQL: ``x`` turned so that segment ``start`` holds the lowest bits."""
    r = start * SEGMENT_BITS
    return f"(shiftrightunsigned({x}, {r}) | shiftleft({x}, {64 - r}))" if r else x


def _long(mask: int) -> str:
    """SQL literal of 64 unsigned bits."""
    return f"({mask - (1 << 64) if mask >> 63 else mask}L)"


def _chain(x: str, start: int, distance: int) -> str:
    """SQL: every chain of segments of the difference ``x`` from ``start`` is within budget."""
    y, tests = _turned(x, start), []
    for length in range(1, SEGMENTS):
        most = distance * length // SEGMENTS
        if length + 1 < SEGMENTS and distance * (length + 1) // SEGMENTS == most:
            continue  # the longer chain has the same budget
        mask = (1 << (SEGMENT_BITS * length)) - 1
        tests.append(f"({y} & {_long(mask)}) = 0" if most == 0 else f"bit_count({y} & {_long(mask)}) <= {most}")
    return " AND ".join(tests)


def _keys(distance: int) -> list[tuple[int, int]]:
    """(start, mask over the turned fingerprint) of each candidate key: the
    segments without budget, then one of (budget + 1) parts of the segments that follow."""
    none = max(n for n in range(SEGMENTS + 1) if distance * n < SEGMENTS)
    head = (1 << (SEGMENT_BITS * none)) - 1
    upto = max(n for n in range(SEGMENTS + 1) if distance * n // SEGMENTS <= 1) if distance else none
    rest = SEGMENT_BITS * (upto - none)
    parts = [0] if not rest else [((1 << (rest // 2)) - 1) << (SEGMENT_BITS * none),
                                  ((1 << (rest - rest // 2)) - 1) << (SEGMENT_BITS * none + rest // 2)]
    return [(s, head | p) for s in range(SEGMENTS if distance else 1) for p in parts]


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b) with a < b for all pairs of distinct fingerprints ``fp`` that differ in
    at most ``distance`` bits, each once. A fingerprint has at most as many partners
    as the Hamming ball has points, however many documents share it. Spark estimates the keys' size
    without counting that each fingerprint has 32 of them, so the join is never left to a broadcast."""
    if not 0 <= distance <= 5:
        raise ValueError("distance must be 0 to 5")
    if distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    keys = _keys(distance)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.expr(f"{_turned('fp', s)} & {_long(m)}") for s, m in keys])).alias("key", "part"))
    x = "(l.fp ^ r.fp)"
    chains = {s: _chain(x, s, distance) for s, _ in keys}
    here = " ".join(f"WHEN {k} THEN {chains[s]}" for k, (s, _) in enumerate(keys))
    first = " ".join(f"WHEN ({_turned(x, s)} & {_long(m)}) = 0 AND {chains[s]} THEN {k}" for k, (s, m) in enumerate(keys))
    pair = F.expr(f"l.key = r.key AND l.part = r.part AND l.fp < r.fp AND CASE l.key {here} END"
                  f" AND bit_count({x}) <= {distance} AND l.key = CASE {first} END")
    return keyed.alias("l").join(keyed.alias("r").hint("merge"), pair).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def _classed(docs: DataFrame, distance: int, k: int, seed: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, th, fp, root (the component's smallest fingerprint) and component of every row."""
    each = saved(fingerprints(docs, doc_id, text, k, seed), "fingerprints")
    nodes = saved(each.groupBy("fp").agg(F.min(id_order("doc_id")).alias("least")), "nodes")
    roots = components(links(nodes, distance))
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "least")
    best = linked.groupBy("root").agg(F.min("least").alias("best"))
    classes = linked.join(best, "root").select(F.col("fp").alias("linked_fp"), "root", "best")
    classes = saved(nodes.join(classes, F.col("fp") == F.col("linked_fp"), "left").select(
        F.col("fp").alias("node_fp"), F.coalesce("root", "fp").alias("root"), F.coalesce("best", "least").alias("component")), "classes")
    # a fingerprint shared by very many documents is a skewed key: both sides are
    # plain scans here, so that the join can be split at run time
    return each.join(classes, F.col("fp") == F.col("node_fp"))


def near_duplicates(docs: DataFrame, distance: int = 3, k: int = 3, seed: int = 42, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents with one fingerprint are one node; nodes link at ``distance`` or
    fewer differing bits; component_id is the smallest doc_id reachable. Null and
    empty texts have fingerprint zero and link like any other. A null doc_id takes
    part; a component of null ids alone has a null component_id. Repeated rows
    stay. An empty table gives an empty result. Other columns are not read.
    """
    return _classed(docs, distance, k, seed, doc_id, text).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component") != MAX_ID, F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, distance: int = 3, k: int = 3, seed: int = 42, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (null
    ids last), then the smallest hash of its text; of repeated rows one stays.
    The documents are shuffled once, by id and text, which have no hot values."""
    first = F.min(F.struct(id_order("doc_id").alias("i"), "th")).alias("first")
    chosen = _classed(docs, distance, k, seed, doc_id, text).groupBy("root").agg(first).select(
        F.xxhash64("first.i", "first.th").alias("__key"), F.col("first.i").alias("__i"), F.col("first.th").alias("__h"))
    row = docs.select(whole_row(docs), id_order(F.col(doc_id).cast("long")).alias("__id"), _text_hash(F.col(text)).alias("__th"))
    row = row.withColumn("__k", F.xxhash64("__id", "__th"))
    kept = row.join(chosen.distinct(), F.expr("__k = __key AND __id = __i AND __th = __h"), "left_semi")
    return kept.dropDuplicates(["__k", "__id", "__th"]).select("__row.*")  # the join's partitioning serves
