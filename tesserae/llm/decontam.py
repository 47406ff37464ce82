"""Benchmark decontamination over canonicalised templates.

Numbers, units and names become typed placeholders, so a re-parameterised
question has the windows of the original. What stood in the placeholders (the
slots) must then map consistently between the two.
"""

from __future__ import annotations

import itertools
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import words as W
from tesserae.llm.common import bitmap, in_bitmap, saved

WINDOW = 5
#: Bits of the bitmap of benchmark windows (2 MB), whatever the benchmark's size.
MAP_BITS = 24
#: Words after a number that count as its unit.
UNITS = ("mm cm m km in ft mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
         "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ton tons ml l liter liters litre litres gallon gallons "
         "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
         "percent degrees dollars dollar euros euro cents cent % $ €").split()
_NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*%?")
_TRIM = re.compile(r"^\W+|\W+$")
_PLAIN, _NUM, _UNIT, _NAME = range(4)
_MARK = np.array([0] + [xxhash.xxh64_intdigest(x) for x in (b"<number>", b"<unit>", b"<name>")], np.uint64)
CACHE_WORDS = 1_000_000
#: Bytes of text whose words are told apart at once, and words whose windows are made at once.
TEXT_BYTES, AT_ONCE = 16 << 20, 500_000
_UNITS_SET = frozenset(UNITS)


def _word(word: bytes) -> tuple[int, int, bool]:
    """Hash of a word's trimmed lower-case form, its kind, and whether it ends a sentence."""
    s = word.decode("utf-8", "replace")
    if s.isalnum():
        core = s
    elif s[:-1].isalnum() and s[-1] != "_":
        core = s[:-1]
    else:
        core = _TRIM.sub("", s) or s
    low = core.lower()
    if not core.isalpha() and _NUMBER.fullmatch(s.strip(".,;:!?()[]\"'")):  # what is trimmed has no digit
        kind = _NUM
    elif low in _UNITS_SET:
        kind = _UNIT
    else:
        kind = _NAME if core[:1].isupper() else _PLAIN
    return xxhash.xxh64_intdigest(low), kind, s[-1] in ".!?:;" or s[-2:-1] in (".", "!", "?")


class _Words:
    """What ``_word`` says of the words that a worker knows, a row each; starts afresh when large."""

    def __init__(self):
        self.row: dict[bytes, int] = {}
        self.core, self.kind, self.ends = array("Q"), array("b"), array("b")

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, kind and end of each word of a column of texts, and the number of words of each."""
        distinct, codes, counts = W.coded(texts)
        words = distinct.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > CACHE_WORDS:
            self.__init__()
            new = words
        for w in new:
            core, kind, ends = _word(w)
            self.row[w] = len(self.core)
            self.core.append(core)
            self.kind.append(kind)
            self.ends.append(ends)
        row = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        take = lambda x, of: np.frombuffer(x, of)[row][codes] if len(row) else np.zeros(0, of)
        return take(self.core, np.uint64), take(self.kind, np.int8), take(self.ends, bool), counts


_known = _Words()


class _Template:
    """The words of a batch of texts: kind, core hash, and whether a capitalised word begins a sentence.

    Such an opening word may be a name or not: its place does not tell. Windows
    stand in both readings. A unit word counts as a unit only after a number.
    """

    def __init__(self, core: np.ndarray, kind: np.ndarray, ends: np.ndarray, counts: np.ndarray):
        self.core, self.counts, kind = core, counts, kind.astype(np.int64)
        self.starts = W.starts_of(counts)
        first = _first(counts, len(core))
        opens, after_number = first.copy(), np.zeros(len(core), bool)
        opens[1:] |= ends[:-1]
        after_number[1:] = kind[:-1] == _NUM
        self.kind = np.where((kind == _UNIT) & ~(after_number & ~first), _PLAIN, kind)
        self.opener = (kind == _NAME) & opens

    def slots(self, p: np.ndarray, size: int, kind: np.ndarray, mask: np.ndarray) -> list[list[int]]:
        """Of windows of ``size`` words: the hash of each word that is a placeholder, else 0."""
        at = p[:, None] + np.arange(size)
        held = (kind[at] != _PLAIN) | ((mask[:, None] >> np.arange(size)) & 1 == 1)
        return np.where(held, self.core[at] | np.uint64(1), np.uint64(0)).view(np.int64).tolist()

    def readings(self, p: np.ndarray, size: int, kind: np.ndarray, either: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash, mask) of the windows at ``p``, in every reading: each set of
        their ``either`` words (plain in ``kind``) taken as names is one, and its bits are the mask."""
        token = np.where(kind == _PLAIN, self.core, _MARK[kind])
        open_bits = np.zeros(len(p), np.int64)
        for j in range(size):
            open_bits |= either[p + j].astype(np.int64) << j
        out = [(p, W.rolling(token, size)[p], np.zeros(len(p), np.int64))]
        some, bits = p[open_bits > 0], open_bits[open_bits > 0]
        for m in range(1, 1 << size):
            q = some[bits & m == m]
            if len(q):
                total = np.zeros(len(q), np.uint64)
                for j in reversed(range(size)):
                    total = total * np.uint64(W._BASE) + (_MARK[_NAME] if m >> j & 1 else token[q + j])
                out.append((q, W.mix(total), np.full(len(q), m)))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def windows(self, window: int):
        """(size, starts, hashes, masks, kinds) of all windows of ``window`` words. Windows of
        placeholders alone say nothing about a text: they count by their words, and have no slots."""
        kind = np.where(self.opener, _PLAIN, self.kind)
        p, h, m = self.readings(W.window_starts(self.counts, window), window, kind, self.opener)
        held = np.zeros(len(kind) + 1, np.int32)
        np.cumsum(kind != _PLAIN, out=held[1:])
        many = held[p + window] - held[p]
        read = np.flatnonzero(m)
        many[read] += sum((m[read] >> j) & 1 for j in range(window)).astype(np.int32)
        blank = many == window
        if blank.any():
            q = np.unique(p[blank])
            total = np.zeros(len(q), np.uint64)
            for j in reversed(range(window)):
                total = total * np.uint64(W._BASE) + self.core[q + j]
            yield window, q, W.mix(total + np.uint64(256)), np.zeros(len(q), np.int64), np.zeros(len(kind), np.int64)
            p, h, m = p[~blank], h[~blank], m[~blank]
        yield window, p, h, m, kind
        for n in range(1, window):  # texts of fewer words are one window of all of them
            p = self.starts[self.counts == n]
            if len(p):
                token = np.where(kind == _PLAIN, self.core, _MARK[kind])
                yield n, p, W.mix(W.rolling(token, n)[p] + np.uint64(n)), np.zeros(len(p), np.int64), kind

    def short(self, lengths: list[int], window: int, item: bool):
        """The same of windows of ``lengths`` words: of an item just all its words.

        So short a window says little: an opening word of an item stays itself, and
        windows of placeholders alone count by their words.
        """
        names = self.kind == _NAME
        kind = np.where(self.opener if item else names, _PLAIN, self.kind)
        plain = np.zeros(len(kind), np.int64)
        for n in lengths:
            p = self.starts[self.counts == n] if item else W.window_starts(self.counts, n)
            if not len(p):
                continue
            q, h, m = self.readings(p, n, kind, np.zeros(len(kind), bool) if item else names)
            said = ((kind[q[:, None] + np.arange(n)] == _PLAIN) & ((m[:, None] >> np.arange(n)) & 1 == 0)).any(axis=1)
            yield n, q[said], W.mix(h[said] + np.uint64(n + 64)), m[said], kind
            q = p[(self.kind[p[:, None] + np.arange(n)] != _PLAIN).all(axis=1)] if not item else q[~said]
            yield n, q, W.mix(W.rolling(self.core, n)[q] + np.uint64(n + 128)), np.zeros(len(q), np.int64), plain


def _templates(texts: pa.Array) -> Iterator[tuple[int, _Template]]:
    """(first text, template) of runs of texts."""
    for at, to in W.runs(W.sizes(texts), TEXT_BYTES):
        core, kind, ends, counts = _known.of(texts.slice(at, to - at))
        past = np.concatenate(([0], np.cumsum(counts)))
        for k, end in W.runs(counts, AT_ONCE):
            a, b = past[k], past[end]
            yield at + k, _Template(core[a:b], kind[a:b], ends[a:b], counts[k:end])


def _first(counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[W.starts_of(counts)[counts > 0]] = True
    return out


def _windows(rows: DataFrame, window: int, schema: str, lengths: list[int], keep=None) -> DataFrame:
    """(id columns, pos, wh, slots) of the template windows of column ``__t``, one row for each
    reading; ``lengths``: of short windows; ``keep``: a broadcast bitmap that a window's hash must
    hit, for documents; without it the rows are items."""
    ids = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(keep.value, np.uint64) if keep is not None else None
        for whole in batches:
            for at, t in _templates(whole.column(0)):
                b = whole.slice(at, len(t.counts))
                for size, p, h, mask, kind in itertools.chain(t.windows(window), t.short(lengths, window, keep is None)):
                    if cells is not None:
                        x = h & np.uint64(len(cells) * 64 - 1)
                        hit = (cells[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1
                        p, h, mask = p[hit], h[hit], mask[hit]
                    doc = np.searchsorted(np.cumsum(t.counts), p, side="right")
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(k + 1).take(pa.array(doc)) for k in range(len(ids))),
                         pa.array((p - t.starts[doc]).astype(np.int32)), pa.array(h.view(np.int64)),
                         pa.array(t.slots(p, size, kind, mask), pa.list_(pa.int64()))],
                        names=[c for c, _ in ids] + ["pos", "wh", "slots"])

    return rows.select("__t", *[c for c, _ in ids]).mapInArrow(run, f"{schema}, pos int, wh long, slots array<long>")


def _lengths(n: int, window: int) -> list[int]:
    """Lengths (in window starts) of the passages in which an item of ``n`` windows is
    sought: its own, then with ever more put in, up to its length again and at least
    ``20 * window`` words."""
    out, more = [n], window
    while more < max(n, 20 * window):
        out.append(n + more)
        more *= 2
    return [*out, n + max(n, 20 * window)]


def _passages(rows: list[tuple], at: dict[int, list], need: int, lengths: list[int]) -> list[tuple[int, int, int, int]]:
    """(item windows met, length, first row, row past the last) of the passages that meet ``need`` of them.
    ``rows``: (pos, hash, slots) in order; a passage begins at any of their positions."""
    out, seen = [], set()
    for length in lengths:
        cover: dict[int, int] = {}
        j = 0
        for i, (pos, wh, _) in enumerate(rows):
            while j < len(rows) and rows[j][0] < pos + length:
                for ipos in {x for x, _ in at[rows[j][1]]}:
                    cover[ipos] = cover.get(ipos, 0) + 1
                j += 1
            if len(cover) >= need and (i == 0 or rows[i - 1][0] < pos) and (i, j) not in seen:
                seen.add((i, j))
                out.append((len(cover), length, i, j))
            for ipos in {x for x, _ in at[wh]}:
                cover[ipos] -= 1
                if not cover[ipos]:
                    del cover[ipos]
    return sorted(out, key=lambda x: (-x[0], *x[1:]))


def _place(rows: list[tuple], at: dict[int, list]) -> list[tuple]:
    """Slots of the item and of the passage for each item window that finds a place of its own in the passage.

    Whole shifts are given out, the one that places most windows first (then the
    one with most equal slots, then the nearest to the first), so a copy keeps its own shift
    although its windows recur nearby.
    """
    met: dict[tuple[int, int], tuple] = {}
    for pos, wh, slots in rows:
        for ipos, islots in at[wh]:
            old = met.get((ipos, pos))
            if old is None or np.count_nonzero(islots) < np.count_nonzero(old[0]):
                met[ipos, pos] = (islots, slots)
    pairs = np.array(list(met), np.int64)
    equal = np.fromiter((x == y for x, y in met.values()), np.int64, len(met))
    left, placed, first = np.arange(len(pairs)), [], None
    while len(left):
        shift = pairs[left, 1] - pairs[left, 0]
        shifts, which, many = np.unique(shift, return_inverse=True, return_counts=True)
        far = np.abs(shifts - first) if first is not None else np.zeros(len(shifts), np.int64)
        best = shifts[np.lexsort((far, -np.bincount(which, equal[left]), -many))[0]]
        first = best if first is None else first
        now = left[shift == best]
        placed.extend(now.tolist())
        left = left[~np.isin(pairs[left, 0], pairs[now, 0]) & ~np.isin(pairs[left, 1], pairs[now, 1])]
    slots = list(met.values())
    return [slots[k] for k in placed]


def _consistency(placed: list[tuple]) -> float:
    """Share of the slots that map one to one; 1 without slots."""
    c = Counter((x, y) for xs, ys in placed for x, y in zip(xs, ys, strict=True) if x and y)
    wx, wy = Counter(x for x, _ in c), Counter(y for _, y in c)
    return sum(n for (x, y), n in c.items() if wx[x] == wy[y] == 1) / sum(c.values()) if c else 1.0


def _best(item: list[dict], met: list[dict], window: int, similarity: float) -> tuple[float, float] | None:
    """(overlap, consistency) of the passage that holds most of the item, none if no passage holds it.
    ``item``: all its windows; ``met``: the document's windows that the item has."""
    at: dict[int, list] = {}
    for w in item:
        at.setdefault(w["wh"], []).append((w["pos"], w["slots"]))
    n = len({w["pos"] for w in item})
    need = math.ceil(n * similarity - 1e-9)
    rows = sorted(((w["pos"], w["wh"], w["slots"]) for w in met), key=lambda r: r[:2])
    best = None
    for most, _, i, j in _passages(rows, at, need, _lengths(n, window)):
        if best and most / n <= best[0]:
            break
        placed = _place(rows[i:j], at)
        sure = _consistency(placed)
        if len(placed) >= need and sure >= similarity and (not best or len(placed) / n > best[0]):
            best = (len(placed) / n, sure)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = 0.8,
                 doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, th, item_id, overlap, consistency) for every document and benchmark
    item that it holds; th is the XXH64 of the document's text (null: empty).

    An item is held if at least ``similarity`` of its template windows occur in a
    passage of the document, each at a position of its own, wherever the passage
    stands and whatever is put in between (up to the item's length again, and at
    least 20 * ``window`` words), and at least ``similarity`` of their slots map
    one to one between item and passage.

    A capitalised word that begins a text or sentence may be a name or a plain word;
    either reading counts. Windows of placeholders alone (number tables, lists of names)
    match only word by word: their templates are alike in all texts. An item of fewer words than ``window`` is one window of
    all its words, sought in every document; there its opening word is plain, and if
    it has placeholders alone, a document holds it word by word, or is as short and alike.

    Documents' windows that miss a fixed-size bitmap of benchmark windows are never
    shuffled. Pairs arise only from each item's rarest windows: so many that an
    item which reaches ``similarity`` must match one of them, so phrases that very
    many items share make no pairs. Null and empty texts hold nothing. Items
    without words, or without id, are ignored; items of one id are judged one by
    one. Repeated rows count alike. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    bench = benchmark.where(f"`{item_id}` is not null").select(
        F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("__t"), F.xxhash64(item_text).alias("ih"))
    bench = saved(_windows(bench.distinct(), window, "item_id long, ih long", list(range(1, window))), "benchmark")
    item = ["item_id", "ih"]
    n_of = bench.groupBy(*item).agg(F.count_distinct("pos").alias("n"))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(t.cast("binary").alias("__t"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"))
    shared = spark.sparkContext.broadcast(bitmap(bench, "wh", MAP_BITS))
    size = F.size("slots")
    lengths = sorted(r[0] for r in bench.where(size < window).select(size).distinct().collect())
    found = saved(_windows(rows, window, "doc_id long, th long", lengths, shared).distinct(), "doc-windows")

    # an item's rarest windows, in all their readings: one more than it may miss
    often = bench.groupBy("wh").agg(F.countDistinct(*item).alias("often")).withColumnRenamed("wh", "w")
    rarity = bench.join(often, F.col("wh") == F.col("w")).groupBy(*item, "pos").agg(F.sum("often").alias("often"), F.min("wh").alias("w"))
    by_rarity = F.row_number().over(Window.partitionBy(*item).orderBy("often", "w", "pos"))
    rarest = rarity.join(n_of, item).withColumn("r", by_rarity).where(
        F.col("r") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).select(*item, "pos")
    probes = bench.join(rarest, [*item, "pos"]).select("item_id", "ih", "wh").distinct()
    pairs = found.select("doc_id", "th", "wh").distinct().join(probes, "wh").select("doc_id", "th", "item_id", "ih").distinct()

    # the document's windows that those items have, all of a pair in one row; the windows' files say little of their
    # size (few hashes and slots, each often), so their join is never left to a broadcast
    same = F.expr("i.doc_id <=> d.doc_id AND i.th = d.th AND i.wh = d.wh")
    key = ["doc_id", "th", *item]
    met = pairs.join(bench.select(*item, "wh").distinct(), item).alias("i").join(found.alias("d").hint("merge"), same).select(
        *[f"i.{c}" for c in key], F.struct("pos", "d.wh", "slots").alias("w")).groupBy(*key).agg(F.collect_list("w").alias("met"))
    whole = bench.groupBy(*item).agg(F.collect_list(F.struct("pos", "wh", "slots")).alias("windows"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                got = [_best(w, m, window, similarity) for w, m in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
                held = pa.array([k for k, g in enumerate(got) if g], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(held) for k in range(3)), *(pa.array([g[k] for g in got if g], pa.float64()) for k in (0, 1))],
                    names=["doc_id", "th", "item_id", "overlap", "consistency"])

    scored = met.join(whole, item).select("doc_id", "th", "item_id", "windows", "met").mapInArrow(
        judge, "doc_id long, th long, item_id long, overlap double, consistency double")
    return scored.groupBy("doc_id", "th", "item_id").agg(F.max("overlap").alias("overlap"), F.max("consistency").alias("consistency"))


def flags(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, first_item (smallest id
    or null) and overlap (the largest, 0 if none)."""
    hit = saved(contaminated(docs, benchmark, doc_id=doc_id, text=text, **how).groupBy("doc_id", "th").agg(
        F.count_distinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"), F.max("overlap").alias("overlap")),
        "contaminated")
    each = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    return each.alias("a").join(hit.alias("b"), F.expr("a.doc_id <=> b.doc_id AND a.th = b.th"), "left").select(
        "a.doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "first_item", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all others as they are.

    Documents that certainly hold none (a fixed-size bitmap of those that do) pass
    without a shuffle; the rest are decided by an exact anti join.
    """
    hit = saved(contaminated(docs, benchmark, doc_id=doc_id, text=text, **how).select("doc_id", "th").distinct(), "contaminated")
    key = lambda i, h: F.xxhash64(F.coalesce(i, F.lit(-1)), h)
    th = F.xxhash64(F.coalesce(F.col(f"d.{text}"), F.lit("")))
    data = bitmap(hit.select(key(F.col("doc_id"), F.col("th")).alias("k")), "k", MAP_BITS)
    maybe = in_bitmap(docs.sparkSession, data, key(F.col(f"d.{doc_id}").cast("long"), th))
    named = docs.alias("d")
    clean = named.where(~maybe)
    rest = named.where(maybe).join(hit.alias("h"), F.col(f"d.{doc_id}").cast("long").eqNullSafe(F.col("h.doc_id")) & (th == F.col("h.th")),
                                   "left_anti")
    return clean.unionByName(rest)
