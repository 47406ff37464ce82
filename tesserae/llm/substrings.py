"""Removal of repeated word windows, with a count-min prefilter and an exact second pass."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import words as W
from tesserae.llm.common import bitmap, id_order, in_bitmap, saved

WINDOW, GRAM = 20, 8
#: Cells of a sketch row in one block, as a power of two; blocks merge independently.
BLOCK_BITS = 18
#: Least and most bits (as powers of two) of the bitmaps of repeated texts and of documents with repeated windows.
MAP_BITS, MOST_MAP_BITS = 24, 28
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def sketch_bits(n_bytes: int, most: int = 28) -> int:
    """Cells of each sketch row as a power of two: about 4 for each anchor (one in
    7 words of 6 bytes), at least one block, at most 2**most (32 MB as a bitmap)."""
    return min(most, max(BLOCK_BITS, int(np.ceil(np.log2(max(n_bytes, 1) / 10)))))


def map_bits(members: int) -> int:
    """Bits of a bitmap for that many members, as a power of two: eight or more for each, so that few others
    hit it, up to 2**MOST_MAP_BITS (32 MB)."""
    return max(MAP_BITS, min(MOST_MAP_BITS, (8 * members).bit_length()))


def _cells(anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's cell in each of the two rows of the sketch."""
    return anchor >> np.uint64(64 - bits), W.mix(anchor ^ _OTHER) >> np.uint64(64 - bits)


def _anchors(h: np.ndarray, counts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, their anchors' positions, gram hashes): a window's anchor is
    the leftmost of its grams with the smallest hash. Equal windows have equal
    anchors at equal places, so a window occurs no more often than its anchor gram."""
    p = W.window_starts(counts, window)
    g = W.rolling(h, gram)
    if not len(p):
        return p, p, g
    m = window - gram + 1
    best, at = g[p].copy(), p.copy()
    for k in range(1, m):
        here = g[p + k]
        less = here < best
        best[less] = here[less]
        at[less] = (p + k)[less]
    return p, at, g


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _hit(cells: np.ndarray, h: pa.Array) -> np.ndarray:
    """Whether the bits of the hashes are set in a bitmap (uint64 cells)."""
    x = h.to_numpy().astype(np.uint64) & np.uint64(len(cells) * 64 - 1)
    return (cells[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1


def _firsts(batches: Iterator[pa.RecordBatch], copied) -> Iterator[pa.RecordBatch]:
    """Rows (__t, __did, __th, __route) to be searched: of a scan (route 1) those
    whose text is certainly single; all others. One Python worker does this and
    the search."""
    cells = np.frombuffer(copied.value, np.uint64)
    for b in _slices(batches):
        yield b.filter(pa.array(~((b.column(3).to_numpy() == 1) & _hit(cells, b.column(2)))))


def _sketch(docs: DataFrame, copied, bits: int, window: int, gram: int) -> bytearray:
    """Two bitmaps of 2**bits cells: whether at least two anchors fell into the cell.

    Every task emits its sketch sparsely (cells it touched, and whether more than
    once); tasks that own a block add up all parts of it; the merged bitmaps have
    a fixed size and go to the driver, to be broadcast.
    """
    block = 1 << BLOCK_BITS
    blocks = 1 << (bits - BLOCK_BITS)

    def part(cells: list[np.ndarray], row: int) -> Iterator[pa.RecordBatch]:
        c, n = np.unique(np.concatenate(cells), return_counts=True)
        code = ((c & np.uint64(block - 1)) << np.uint64(1) | (n > 1).astype(np.uint64)).astype("<u4")
        owner = (c >> np.uint64(BLOCK_BITS)).astype(np.int64)
        cut = np.flatnonzero(np.diff(owner)) + 1
        keys = owner[np.concatenate(([0], cut))] + row * blocks
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([x.tobytes() for x in np.split(code, cut)], pa.binary())],
                                         names=["block", "cells"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], []), 0
        for b in _firsts(batches, copied):
            h, counts = W.flat(b.column(0).to_pylist())
            h = W.hashes(h)
            _, at, g = _anchors(h, counts, window, gram)
            at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
            for row, c in enumerate(_cells(g[at], bits)):
                held[row].append(c)
            size += len(at)
            if size > 1 << 21:
                for row in (0, 1):
                    yield from part(held[row], row)
                held, size = ([], []), 0
        if size:
            for row in (0, 1):
                yield from part(held[row], row)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                code = np.frombuffer(raw, "<u4")
                cells = sums.setdefault(key, np.zeros(block, np.uint8))
                i = code >> 1
                cells[i] = np.minimum(cells[i] + 1 + (code & 1).astype(np.uint8), 2)
        for key, cells in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([np.packbits(cells > 1, bitorder="little").tobytes()], pa.binary())],
                names=["block", "bits"])

    merged = docs.select("__t", "__did", "__th", "__route").mapInArrow(emit, "block long, cells binary").repartition("block").mapInArrow(
        merge, "block long, bits binary")
    out = bytearray(2 * blocks * block // 8)
    for r in merged.toLocalIterator():
        out[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = r["bits"]
    return out


def _suspects(docs: DataFrame, copied, sketch: bytearray, bits: int, window: int, gram: int) -> DataFrame:
    """(did, th, pos, key, key2, h, check) of every stretch whose anchor is estimated to repeat: all windows of one
    anchor, which start at consecutive words from ``pos`` on. ``h`` and ``check`` list 64 and 32 bits of two independent
    hashes of each window's words; ``key`` and ``key2`` are as many of the stretch's, of which the first and
    the last window hold every word."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(shared.value, np.uint8)
        row = len(cells) // 2
        for b in _firsts(batches, copied):
            ws, counts = W.flat(b.column(0).to_pylist())
            h = W.hashes(ws)
            p, at, g = _anchors(h, counts, window, gram)
            hit = np.ones(len(p), bool)
            for k, c in enumerate(_cells(g[at], bits)):
                hit &= (cells[k * row + (c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 == 1
            p, at = p[hit], at[hit]
            if not len(p):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(p)]))
            lo, hi, n = cuts[:-1], cuts[1:] - 1, np.diff(cuts).astype(np.uint64)
            h1, h2 = W.rolling(h, window)[p], W.rolling(W.mix(h ^ _OTHER), window)[p]
            key, key2 = (W.mix(x[lo] ^ W.mix(x[hi] + n)) for x in (h1, h2))
            start = p[lo]
            doc = np.searchsorted(np.cumsum(counts), start, side="right")
            ends = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(1).take(pa.array(doc)), b.column(2).take(pa.array(doc)),
                 pa.array((start - W.starts_of(counts)[doc]).astype(np.int32)), pa.array(key.view(np.int64)), _upper(key2),
                 pa.ListArray.from_arrays(ends, pa.array(h1.view(np.int64))), pa.ListArray.from_arrays(ends, _upper(h2))],
                names=["did", "th", "pos", "key", "key2", "h", "check"])

    return docs.select("__t", "__did", "__th", "__route").mapInArrow(
        emit, "did long, th long, pos int, key long, key2 int, h array<long>, check array<int>")


def _upper(h: np.ndarray) -> pa.Array:
    return pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _late(stretches: DataFrame) -> DataFrame:
    """(did, th, pos, n): runs of n consecutive windows from ``pos`` on that all start earlier too.

    A stretch that starts earlier as a whole is one such run. Only first ones give up their windows to be grouped
    one by one: a later one's are late, and never the first of their words.
    """
    spark = stretches.sparkSession
    place = F.struct("did", "pos")
    whole = saved(stretches.groupBy("key", "key2").agg(F.min(place).alias("place")).select(
        F.xxhash64("key", "key2", "place.did", "place.pos").alias("k")), "stretches")
    in_whole = in_bitmap(spark, bitmap(whole, "k", map_bits(whole.count())), F.xxhash64("key", "key2", "did", "pos"))
    told = stretches.withColumn("__f", in_whole)
    again = told.where("not __f").select("did", "th", "pos", F.size("h").alias("n"))  # the bitmap misses it: certainly not the first

    starts = F.sequence(F.col("pos"), F.col("pos") + F.size("h") - 1).alias("pos")
    windows = told.where("__f").select("did", "th", F.inline(F.arrays_zip(starts, "h", "check")))
    first = windows.groupBy("h", "check").agg(F.min(place).alias("place"), F.count("*").alias("n")).where("n > 1").select(
        F.col("h").alias("h0"), F.col("check").alias("c0"), "place")
    first = saved(first, "places")
    in_first = in_bitmap(spark, bitmap(first, "h0", map_bits(first.count())), F.col("h"))
    late = windows.where(in_first).join(
        first, (F.col("h") == F.col("h0")) & (F.col("check") == F.col("c0")) & (place > F.col("place")))
    return again.unionByName(late.select("did", "th", "pos", F.lit(1).alias("n")))


def _result(rows: DataFrame, copied, repeated, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept from (__id, __t, __first, pos,
    __th, __key, __route). Of a scan (route 1), rows that the bitmaps of copied texts
    and of repeated windows miss; of copies (route 2), later ones and those without
    repeated windows; all others (route 0). A copy of an earlier text loses every
    word if it has a window at all. ``pos`` lists runs of repeated windows: the first one's start
    above 32 bits, their number below."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, repeats = np.frombuffer(copied.value, np.uint64), np.frombuffer(repeated.value, np.uint64)
        for b in _slices(batches):
            route, first = b.column(6).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            again = _hit(repeats, b.column(5))
            b = b.filter(pa.array(~((route == 1) & (_hit(copies, b.column(4)) | again) | (route == 2) & first & again)))
            n, gone, sha, text = [], [], [], []
            for t, first, pos in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                ws = (t or b"").split()
                kept = ws
                if not first:
                    kept = ws if len(ws) < window else []
                elif pos:
                    runs = np.array(pos, np.int64)
                    step = np.zeros(len(ws) + window + 1, np.int32)
                    np.add.at(step, runs >> 32, 1)
                    np.add.at(step, (runs >> 32) + (runs & 0xFFFFFFFF) + window - 1, -1)
                    kept = list(compress(ws, (np.cumsum(step)[: len(ws)] == 0).tolist()))
                joined = b" ".join(kept)
                n.append(len(ws))
                gone.append(len(ws) - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                text.append(joined)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(text, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.select("__id", "__t", "__first", "pos", "__th", "__key", "__route").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text",
                   max_sketch_bits: int = 28) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and kept (the
    words left, joined by one space, as UTF-8 bytes).

    A word goes if a window of ``window`` words of its document covers it whose
    word sequence also starts earlier: in a document of smaller id, or earlier in
    the same one. All windows are judged on the input.

    1. A copy of a whole earlier text starts earlier with every window, so only the
       first document of equal texts is searched. Texts whose hash is certainly
       single (bitmap) are never shuffled.
    2. Count-min: merged sketches of all tasks overestimate how often a window's
       anchor gram, hence the window, occurs.
    3. Only windows estimated to repeat are grouped exactly: first whole stretches of
       windows with one anchor, then the single windows of each stretch's first
       place. First places are found by a pre-aggregated minimum; those of windows
       are joined back (a skewed key can split).

    Sketches have a fixed largest size (2 * 2**max_sketch_bits bits); beyond about
    2**max_sketch_bits anchors they let more windows through to step 3, which
    stays exact. The bitmaps are sized by the measured numbers of repeated texts and of documents with repeats, up to
    2**MOST_MAP_BITS bits; beyond some hundred million they let more whole texts through to the exact tests. Null and empty texts have no words. Null ids come after all
    others; rows of one id are one document; repeated rows keep their words alike.
    An empty table gives an empty result. Other columns are not read.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).cast("long").alias("__id"), id_order(F.col(doc_id).cast("long")).alias("__did"),
                       t.cast("binary").alias("__t"), F.xxhash64(t).alias("__th"))
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    bits = sketch_bits(n_bytes, max_sketch_bits)

    twice = saved(base.groupBy("__th").agg(F.count("*").alias("n")).where("n > 1").select("__th"), "twice")
    # bitmaps and sketches are let go as soon as they are broadcast, so the driver's Python holds one of them at a time
    copied = spark.sparkContext.broadcast(bitmap(twice, "__th", map_bits(twice.count())))
    copies = base.where(in_bitmap(spark, copied, F.col("__th"))).withColumn("__md5", F.md5("__t"))
    least = copies.groupBy("__md5").agg(F.min("__did").alias("__least")).withColumnRenamed("__md5", "__same")
    copies = saved(copies.join(least, (F.col("__md5") == F.col("__same")) & (F.col("__did") == F.col("__least")), "left").select(
        "__id", "__did", "__t", "__th", F.col("__least").isNotNull().alias("__first")), "copies")
    searched = base.withColumn("__route", F.lit(1)).select("__t", "__did", "__th", "__route").unionByName(
        copies.where("__first").select("__t", "__did", "__th", F.lit(0).alias("__route")))

    suspects = _suspects(searched, copied, _sketch(searched, copied, bits, window, gram), bits, window, gram)
    late = _late(saved(suspects, "windows"))
    run = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("n")
    found = saved(late.groupBy("did", "th").agg(F.collect_set(run).alias("pos")), "repeats")  # repeated rows add nothing

    repeated = spark.sparkContext.broadcast(bitmap(found.select(F.xxhash64("did", "th").alias("k")), "k", map_bits(found.count())))
    key = F.xxhash64("__did", "__th").alias("__key")
    scan = base.withColumn("__first", F.lit(True)).select("__id", "__did", "__t", "__first", "__th", key, F.lit(1).alias("__route"))
    both = scan.unionByName(copies.select("__id", "__did", "__t", "__first", "__th", key, F.lit(2).alias("__route")))
    maybe_copy, maybe_repeat = in_bitmap(spark, copied, F.col("__th")), in_bitmap(spark, repeated, F.col("__key"))
    hit = both.withColumn("__c", maybe_copy).withColumn("__r", maybe_repeat).where(
        "__r and __first and (__route = 2 or not __c)").withColumn("__route", F.lit(0))
    hit = hit.join(found, (F.col("__did") == F.col("did")) & (F.col("__th") == F.col("th")), "left")
    cols = ["__id", "__t", "__first", "pos", "__th", "__key", "__route"]
    plain = both.withColumn("pos", F.lit(None).cast("array<long>"))
    return _result(plain.select(*cols).unionByName(hit.select(*cols)), copied, repeated, window)
