"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

One inserted, deleted or replaced letter changes a word's letter counts by a squared
distance of at most two. Words are laid in blocks by their letter counts over a few
groups of letters, which fixes their length; only blocks of the same length that differ
by one letter moved between groups, and blocks one letter longer, can hold near words.
A block's words times those of its neighbours are one NumPy product each: with
a squared norm and a constant appended to the count vectors, the product is two
minus the squared distance, and its entries that are not negative are the candidates. Their edits are
then verified on the letters.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import saved

#: Words of one block, and of its neighbours, in one task; larger blocks are dealt over more tasks.
BLOCK, NEIGHBOURS = 4096, 16384
#: Letters of all words in one such part, and entries of one product: they bound a task's memory.
PART_LETTERS, PRODUCT = 1 << 20, 1 << 22
#: Words a task counts before it hands them on.
COUNTED = 400_000

_FOLD = bytes(b if b > 127 else b | 32 if 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # A-Z folded; U+00C0 to U+00FF in UTF-8


def _count(text: str, prefix: bytes, typo_every: int | None, least: int, into: dict[bytes, int]) -> None:
    """Adds the words of one text, by UTF-8 bytes."""
    begin = zlib.crc32(prefix)
    for piece, c in Counter(text.encode().translate(_FOLD).split()).items():
        for w in (piece,) if piece.isascii() else _RUN.findall(piece):
            if len(w) < least:
                continue
            if typo_every:
                h = zlib.crc32(w, begin)
                if h % typo_every == 0:
                    s = w.decode()
                    k = h % len(s)
                    w = (s[:k] + s[k + 1 :]).encode()
            if len(w) >= least and (w.isascii() or len(w.decode()) >= least):
                into[w] = into.get(w, 0) + c


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = 6, least_count: int = 5,
                typo_every: int | None = None) -> DataFrame:
    """word, n: the runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z in lower case, of at least
    ``least_letters`` code points and ``least_count`` occurrences in all documents.

    With ``typo_every`` a run loses one code point where that number divides the crc32 of
    ``<doc_id>:<run>`` (null ids read ``null``): typing slips, the same in every run of the job.
    Null texts have no words; repeated rows count each time. Tasks hand on counts,
    at most COUNTED words at a time, so a word that makes up a third of all text is a few rows of the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            words = pa.array(list(found), pa.binary()).cast(pa.string())
            counts = pa.array(list(found.values()), pa.int64())
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([words.slice(at, 50_000), counts.slice(at, 50_000)], names=["word", "n"])
            found.clear()

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    _count(t, f"{'null' if i is None else i}:".encode(), typo_every, least_letters, found)
                    if len(found) > COUNTED:
                        yield from out()
        yield from out()

    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _weights(groups: int) -> np.ndarray:
    """One odd 64-bit number for each group of letters: a block's key is their sum over a word's letters, so
    moving or adding a letter adds a known number. Keys that clash merge blocks, which does no harm."""
    x = np.arange(1, groups + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) | np.uint64(1)).view(np.int64)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words).view(np.uint32).reshape(len(words), -1)


def _keys(words: list[str], weights: np.ndarray) -> np.ndarray:
    ends = np.cumsum([0] + [len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(weights[codes % len(weights)])))
    return sums[ends[1:]] - sums[ends[:-1]]


def _placed(words: DataFrame, groups: int) -> DataFrame:
    """word, n, its block, and ``below``: the blocks that its block is compared with from
    their side, itself among them. Of two blocks of one length the one of the smaller key compares, of two lengths the shorter."""
    weights = _weights(groups)
    moves = (weights[:, None] - weights)[~np.eye(groups, dtype=bool)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key = _keys(b.column(0).to_pylist(), weights)
            same = key[:, None] + moves
            below = [np.unique(np.concatenate(([k], s[s < k], k - weights))) for k, s in zip(key, same)]
            offsets = np.cumsum([0] + [len(x) for x in below]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(below)))],
                names=["word", "n", "block", "below"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, block long, below array<long>")


def _product_pairs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of two code arrays whose letter counts have a squared distance of at most two."""
    letters, place = np.unique(np.concatenate((a.ravel(), b.ravel())), return_inverse=True)
    place, d = place.ravel(), len(letters)

    def counts(at: int, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        flat = np.repeat(np.arange(n) * d, codes.shape[1]) + place[at : at + codes.size]
        exact = np.float32 if codes.shape[1] <= 1000 else np.float64  # squared norms stay whole numbers
        return np.bincount(flat, minlength=n * d).reshape(n, d).astype(exact)

    x, y = counts(0, a), counts(a.size, b)
    one = lambda v: np.ones((len(v), 1), v.dtype)
    sq = lambda v: (v * v).sum(1, keepdims=True)
    left = np.hstack((2 * x, sq(x), one(x)))
    right = np.ascontiguousarray(np.hstack((y, -one(y), 2 - sq(y))).T)
    step = max(1, PRODUCT // len(b))
    for at in range(0, len(a), step):
        hit = np.flatnonzero(left[at : at + step] @ right >= 0)
        yield at + hit // len(b), hit % len(b)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one replaced code point (equal lengths) or one inserted in ``b``."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    head = np.cumprod(a == b[:, :-1], axis=1).sum(1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= a.shape[1]


_NEAR = "word string, n_near long, best struct<minus_n: long, word: string>"


def _near_in_part(t: pa.Table) -> pa.Table:
    """For each word of one part that has near words in it: their number, and the best of them
    (largest n, then smallest word)."""
    side = t.column("side").to_numpy().astype(bool)
    words, n, block = t.column("word").to_pylist(), t.column("n").to_numpy(), t.column("block").to_numpy()
    order = {w: r for r, w in enumerate(sorted(set(words)))}
    rank = np.array([order[w] for w in words])
    length = np.array([len(w) for w in words])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(length[~side]):
        here = np.flatnonzero(~side & (length == size))
        a = _codes([words[i] for i in here])
        for other in (size, size + 1):
            there = np.flatnonzero(side & (length == other))
            if not len(there):
                continue
            b = _codes([words[i] for i in there])
            for i, j in _product_pairs(a, b):
                if size == other:  # two words of one length meet twice in one block, and in two blocks if keys clash
                    x, y = here[i], there[j]
                    once = (block[x] < block[y]) | ((block[x] == block[y]) & (rank[x] < rank[y]))
                    i, j = i[once], j[once]
                step = max(1, PRODUCT // int(other))
                for at in range(0, len(i), step):
                    ii, jj = i[at : at + step], j[at : at + step]
                    ok = _one_edit(a[ii], b[jj])
                    left.append(here[ii[ok]])
                    right.append(there[jj[ok]])
    x, y = np.concatenate(left + right), np.concatenate(right + left)
    by = np.lexsort((rank[y], -n[y], x))
    x, y = x[by], y[by]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    return pa.table({
        "word": pa.array([words[k] for k in x[first]], pa.string()),
        "n_near": pa.array(np.diff(np.append(first, len(x)))),
        "best": pa.StructArray.from_arrays([pa.array(-n[y[first]]), pa.array([words[k] for k in y[first]], pa.string())],
                                           names=["minus_n", "word"])})


def near_words(words: DataFrame, groups: int | None = None) -> DataFrame:
    """word, n_near, best_n, best: for each of ``words`` (word, n; each word once) that has words one
    edit away (one code point inserted, deleted or replaced), their number and the one of largest n, ties
    to the smallest in code-point order.

    ``groups`` of letters set how fine the blocks are; by default a few more as the vocabulary grows. A block
    is compared with itself and its neighbours in parts of at most about BLOCK words by NEIGHBOURS words,
    fewer of long words, so no task depends on the size of a block. Parts hand on one
    row per word, never pairs. Words of no letters give no rows; an empty table gives an empty one.
    """
    if groups is None:
        groups = min(8, max(3, 3 + round(math.log2(max(words.count(), 1) / 400_000) / 2)))
    placed = saved(_placed(words, groups), "spelling-blocks")
    size = placed.withColumn("letters", F.length("word"))
    # rows a part may hold follow from the block's longest word, so long words come few at a time
    room = lambda most: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(PART_LETTERS) / (F.max("letters") + 1))))
    own = size.groupBy("block").agg(F.ceil(F.count("*") / room(BLOCK)).alias("parts"))
    met = size.select(F.explode("below").alias("block"), "letters").groupBy("block").agg(
        F.ceil(F.count("*") / room(NEIGHBOURS)).alias("slices"))
    plan = saved(own.join(met, "block"), "spelling-plan")
    h = F.xxhash64("word")
    first = placed.select("block", "word", "n").join(plan, "block").select(
        F.col("block").alias("k"), F.pmod(h, F.col("parts")).alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("side"), "block", "word", "n")
    second = placed.select(F.explode("below").alias("k"), "block", "word", "n").join(
        plan.withColumnRenamed("block", "k"), "k").select(
        "k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(h, F.col("slices")).alias("slice"),
        F.lit(1).alias("side"), "block", "word", "n")
    near = first.unionByName(second.select(*first.columns)).groupBy("k", "part", "slice").applyInArrow(_near_in_part, _NEAR)
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")).select(
        "word", "n_near", (-F.col("best.minus_n")).alias("best_n"), F.col("best.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that ``forms`` (word, form) lead to. Each round doubles the steps taken; a form is
    more frequent than its word, so there is no circle, and rounds grow with the logarithm of the longest chain."""
    reached = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = saved(reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                             F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")
        reached = step.select("word", "root")


def group_variants(words: DataFrame, times: int = 5, groups: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``words`` (word, n): the form of a word is its near
    word of largest n where that is at least ``times`` the word's own n (``times`` > 1), else null; the root is
    reached by following forms, and is the word itself where it has none."""
    if times <= 1:
        raise ValueError("forms must be more frequent than their words")
    words = saved(words.select("word", "n"), "spelling-words")
    near = near_words(words, groups)
    fits = F.col("best_n") >= F.lit(times) * F.col("n")
    known = saved(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"),
        F.when(fits, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
