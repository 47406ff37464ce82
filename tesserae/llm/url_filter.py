"""URL filter: host and path rules, host word segmentation, naive Bayes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import words as W
from tesserae.llm.common import bitmap, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of hosts that stand for unwanted pages, with the observations that each adds to the words and to the block class.
SEEDS = {w: 20 for w in ("casino", "bets", "bet", "poker", "pills", "cheap", "adult", "porn", "xxx", "spam", "ads", "track")}
#: Bits of the bitmap of words (2 MB) that substrings have to hit before they are shuffled; letters hashed at a time.
MAP_BITS, LETTERS = 24, 1 << 20
#: What each letter of an unknown word after its first costs.
LONGER = 2.5


@dataclass(frozen=True)
class Rule:
    """``text`` is a host, a slash and the beginning of a path: ``example.org/es/``."""

    verdict: str
    text: str


def host_of(url: Column) -> Column:
    got = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits the host or a parent of it and
    the beginning of the path; null if none does. Of equal rules the first counts."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        domain, _, rest = r.text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(w, n) of all words (runs of a-z, however long) of all whole texts."""
    words = texts.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+")).alias("w"))
    return words.where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))


class Segmenter:
    """Splits concatenated names into the likeliest words of a unigram model."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total``: that of all words plus one, where ``counts`` are only those that a name can hold."""
        self.total = total or sum(counts.values()) + 1
        self.counts = counts

    def cost(self, word: str) -> float:
        """Unknown words cost ever more by length."""
        n = self.counts.get(word)
        return math.log(n / self.total) if n else math.log(1.0 / self.total) - LONGER * (len(word) - 1)

    def split(self, name: str, found: Iterable[tuple[int, str, int]] = ()) -> list[str]:
        """Viterbi over the positions of ``name``; of equal scores the longer last word.

        ``found``: (start, word, n) of the known words that ``name`` holds, besides those of the model's own counts. The best unknown word
        up to a position follows from that up to the position before, so no length is out of reach.
        """
        ends: dict[int, dict[int, float]] = {}
        for w, n in self.counts.items():
            at = name.find(w)
            while at >= 0:
                ends.setdefault(at + len(w), {})[at] = math.log(n / self.total)
                at = name.find(w, at + 1)
        for at, w, n in found:
            if name.startswith(w, at):
                ends.setdefault(at + len(w), {}).setdefault(at, math.log(n / self.total))
        best, back = [0.0] * (len(name) + 1), [0] * (len(name) + 1)
        unknown, begin, first = -math.inf, 0, math.log(1.0 / self.total)
        for j in range(1, len(name) + 1):
            unknown -= LONGER
            if best[j - 1] + first > unknown:
                unknown, begin = best[j - 1] + first, j - 1
            score, start = unknown, begin
            for i, log in ends.get(j, {}).items():
                s = best[i] + log
                if s > score or (s == score and i < start):
                    score, start = s, i
            best[j], back[j] = score, start
        out, j = [], len(name)
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        return out[::-1]


def labels(host: str, path: str) -> list[str]:
    """Runs of letters (h: of the host, p: of the path) in order; runs of digits become 0."""
    return [f"{kind}:{x if x.isalpha() else '0'}" for kind, part in (("h", host), ("p", path.lower()))
            for x in re.findall(r"[a-z]+|[0-9]+", part)]


def seeded(counts: DataFrame | None, seeds: dict[str, int]) -> tuple[dict[str, int], int]:
    """Counts of the seed words, their own observations added, and the
    total of all words plus one. One row and the seeds' rows reach the driver."""
    total = (counts.agg(F.sum("n")).first()[0] or 0) if counts is not None else 0
    have = {r["w"]: r["n"] for r in counts.where(F.col("w").isin(list(seeds))).collect()} if counts is not None and seeds else {}
    return {w: have.get(w, 0) + n for w, n in seeds.items()}, total + sum(seeds.values()) + 1


def _letters(words: list[str]) -> np.ndarray:
    return W.mix(np.frombuffer("".join(words).encode(), np.uint8).astype(np.uint64) + np.uint64(1))


def _hashed(counts: DataFrame) -> DataFrame:
    """(w, n, size, h) with the same rolling hash of each word that substrings have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                b = whole.slice(at, 20_000)
                words = b.column(0).to_pylist()
                h = np.array([W.rolling(_letters([w]), len(w))[0] for w in words], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([len(w) for w in words], pa.int32()), pa.array(h.view(np.int64))], names=["w", "n", "size", "h"])

    return counts.select("w", "n").mapInArrow(run, "w string, n long, size int, h long")


def _substrings(names: DataFrame, sizes: list[int], keep) -> DataFrame:
    """(id, at, size, h) of the substrings of ``names`` (id, name) that have the length of a word and may be one,
    by the broadcast bitmap ``keep``: positions and hashes, never the substrings themselves, in batches of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        cells = np.frombuffer(keep.value, np.uint64)
        mask = np.uint64(len(cells) * 64 - 1)

        def some(ids: list[int], words: list[str]) -> Iterable[pa.RecordBatch]:
            counts = np.array([len(w) for w in words])
            codes, starts, ends = _letters(words), W.starts_of(counts), np.cumsum(counts)
            for size in sizes:
                p = W.window_starts(counts, size)
                if not len(p):
                    continue
                h = W.rolling(codes, size)[p]
                x = h & mask
                hit = (cells[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1
                p, h = p[hit], h[hit]
                name = np.searchsorted(ends, p, side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(ids, np.int64)[name]), pa.array((p - starts[name]).astype(np.int32)),
                     pa.array(np.full(len(p), size, np.int32)), pa.array(h.view(np.int64))], names=["id", "at", "size", "h"])

        for b in batches:
            ids, words, letters = [], [], 0
            for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                words.append(w)
                letters += len(w)
                if letters >= LETTERS:
                    yield from some(ids, words)
                    ids, words, letters = [], [], 0
            if words:
                yield from some(ids, words)

    return names.select("id", "name").mapInArrow(run, "id long, at int, size int, h long")


def segmented(names: DataFrame, counts: DataFrame | None, seeds: dict[str, int]) -> DataFrame:
    """(name, parts): each of the distinct ``name`` split by the counts of all words
    that it holds; these come by a join on the hashes of its substrings, and are compared with it letter by letter.
    Of the words, the lengths that occur reach the driver."""
    have, total = seeded(counts, seeds)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = Segmenter(have, total)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                names = part.column(0).to_pylist()
                parts = [model.split(x, [(r["at"], r["w"], r["n"]) for r in held or () if r["w"] not in have])
                         for x, held in zip(names, part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.list_(pa.string()))], names=["name", "parts"])

    if counts is None:
        held = names.withColumn("held", F.lit(None).cast("array<struct<at:int,w:string,n:bigint>>"))
    else:
        spark = names.sparkSession
        words = saved(_hashed(counts), "word-hashes")
        sizes = sorted(r[0] for r in words.select("size").distinct().collect())
        keep = spark.sparkContext.broadcast(bitmap(words, "h", MAP_BITS))
        # written once, so that numbers stay; dealt evenly, since a few long names may hold most letters
        names = saved(names.select("name").withColumn("id", F.monotonically_increasing_id()), "names")
        some = _substrings(names, sizes, keep).join(words, ["size", "h"]).groupBy("id").agg(
            F.collect_list(F.struct("at", "w", "n")).alias("held"))
        held = names.join(some, "id", "left")
    return held.select("name", "held").mapInArrow(split, "name string, parts array<string>")


def fit(sites: DataFrame, seeds: dict[str, int]) -> tuple[DataFrame, float, float]:
    """From (tokens array, verdict, c rows): (t, weight) of every token, the weight
    of all others, and the prior; multinomial naive Bayes, log odds of block over
    allow. One row and the seeds' rows reach the driver."""
    count = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("c"))), F.lit(0))
    block, allow = count("block").alias("b"), count("allow").alias("a")
    per = saved(sites.select("verdict", "c", F.explode("tokens").alias("t")).groupBy("t").agg(block, allow), "token-counts")
    classes, sums = sites.agg(block, allow).first(), per.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    nb, na, v = sums["b"] or 0, sums["a"] or 0, sums["v"] + 1
    named = [f"h:{w}" for w in seeds]
    have = {r["t"]: (r["b"], r["a"]) for r in per.where(F.col("t").isin(named)).collect()} if named else {}
    for w, n in seeds.items():  # as many observations as given
        b, a = have.get(f"h:{w}", (0, 0))
        v += f"h:{w}" not in have
        have[f"h:{w}"] = (b + n, a)
        nb += n
    spark = sites.sparkSession
    seeded_rows = spark.createDataFrame([(t, b, a) for t, (b, a) in have.items()], "t string, b long, a long")
    all_rows = per.where(~F.col("t").isin(named)).unionByName(seeded_rows)
    weight = F.log((F.col("b") + 1) / F.lit(float(nb + v))) - F.log((F.col("a") + 1) / F.lit(float(na + v)))
    return (all_rows.select("t", weight.alias("weight")), math.log(1 / (nb + v)) - math.log(1 / (na + v)),
            math.log((classes["b"] + 1) / (classes["a"] + 1)))


def judge(pages: DataFrame, rules: Iterable[Rule], page_id: str = "page_id", url: str = "url", html: str | None = "html",
          seeds: dict[str, int] | None = None, learn: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, words (space-joined tokens) and odds.

    The longest rule that fits decides. Elsewhere a naive Bayes model over the
    segmented host and path decides: block if its log odds are above zero. It is
    trained on all pages that rules decide (those that ``learn`` marks, if given), plus ``seeds`` (word: number of
    observations); the words of the segmenter are those of all whole page texts. Neither words nor tokens are
    capped, in number or length: each distinct host and path label meets the words it holds, and each
    distinct host and path its tokens' weights, by joins.

    A url that is null or lacks ``://`` has empty host and path, no rule, and the
    verdict of the model's prior. Null html counts as empty. Repeated rows stay.
    An empty table gives an empty result. Other columns are not read.
    """
    seeds, rules = SEEDS if seeds is None else seeds, list(rules)
    text, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                        (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))).alias("learn"))
    rows = rows.withColumn("rule", text).withColumn("decided", verdict)
    counts = saved(word_counts(pages, html), "word-counts") if html else None

    @F.pandas_udf("array<string>")
    def labelled(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([labels(h, p) for h, p in zip(host, path, strict=True)])

    key = ["host", "path"]
    sites = rows.groupBy(*key).agg(F.first(F.when(F.col("learn"), F.col("decided")), ignorenulls=True).alias("verdict"), F.count("*").alias("c"))
    sites = saved(sites.withColumn("labels", labelled("host", "path")), "sites")
    each = sites.select(*key, F.posexplode("labels").alias("at", "label")).withColumn("name", F.substring("label", 3, 1 << 30))
    parts = saved(segmented(each.where("name <> '0'").select("name").distinct(), counts, seeds), "names")
    kind = F.concat(F.substring("label", 1, 2), F.col("part"))
    joined = each.join(parts, "name", "left").select(
        *key, "at", F.posexplode(F.coalesce("parts", F.array(F.lit("0")))).alias("k", "part"), "label").select(*key, "at", "k", kind.alias("t"))
    words = joined.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "k", "t"))).alias("ts")).select(
        *key, F.col("ts.t").alias("tokens"))
    sites = saved(sites.drop("labels").join(words, key, "left").withColumn(
        "tokens", F.coalesce("tokens", F.array().cast("array<string>"))), "site-tokens")
    weights, other, prior = fit(sites.where("verdict is not null"), seeds)
    scored = sites.select(*key, F.posexplode("tokens").alias("at", "t")).join(weights, "t", "left").groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("weight", F.lit(other)).alias("w")))).alias("ws")).select(
        *key, F.aggregate("ws.w", F.lit(0.0), lambda x, w: x + w).alias("sum"))
    # written, so that a url which a third of all pages share is a skewed key between two plain scans
    judged = saved(sites.join(scored, key, "left").select(
        *key, F.concat_ws(" ", "tokens").alias("words"), (F.lit(prior) + F.coalesce("sum", F.lit(0.0))).alias("odds")), "judged")
    by_model = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return rows.join(judged, key).select("page_id", "host", "path", "rule", F.coalesce("decided", by_model).alias("verdict"), "words", "odds")
