"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow boosted trees are grown on a bounded labelled sample; every path from the
root is a conjunctive rule; a lasso logistic regression keeps few of the rules;
those are compiled into Spark column expressions over the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = ("log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "pipe", "space", "stop", "line_words",
              "distinct_words", "repeated_words", "repeated_lines", "odd_words", "shout_words")
_CLASS = np.zeros((256, 6))
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!#$%&*+<=>@\\^_`{|}~", b"|", b" \t\n\r\x0b\x0c", b".,")):
    _CLASS[list(_set), _k] = 1


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of one whole text (UTF-8); zeros for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    words, n = text.split(), len(text)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / n
    m, lines = max(1, len(words)), [x for x in text.split(b"\n") if x]
    odd = sum(map(bytes.endswith, words, [(b"*", b"#", b"%", b"$", b"&", b"!!", b"|")] * len(words)))
    return [math.log1p(n), math.log1p(len(words)), (n - len(words)) / m, *shares.tolist(), len(words) / max(1, len(lines)),
            len(set(words)) / m, sum(map(eq, words, words[1:])) / m, 1 - len(set(lines)) / max(1, len(lines)), odd / m,
            sum(map(bytes.isupper, words)) / m]


def with_statistics(docs: DataFrame, text: str, ids: list[Column]) -> DataFrame:
    """``ids`` columns (long, named) and the statistics of every whole text."""
    names = [f"s_{s}" for s in STATISTICS]
    src = docs.select(F.col(text).cast("binary").alias("__t"), *ids)
    kept = src.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                x = np.array([statistics(t or b"") for t in b.column(0).to_pylist()], np.float64).reshape(b.num_rows, len(names))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c) for c in x.T.copy())], names=[*kept, *names])

    return src.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in src.dtypes[1:]] + [f"{n} double" for n in names]))


@dataclass(frozen=True)
class Test:
    """statistic > cut (``above``) or statistic <= cut."""

    statistic: int
    cut: float
    above: bool


Rule = tuple[Test, ...]


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: Rule, depth: int,
          least: int, rules: list[Rule], step: np.ndarray, rate: float) -> None:
    """Grow a regression tree on binned statistics; note every path; add leaf values to ``step``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-9, None)
    if depth:
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = x[rows, j]
            n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gl = np.cumsum(np.bincount(b, grad[rows], minlength=len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < least) | (len(rows) - n < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
    if best[1] is None:
        step[rows] += rate * g / (h + 1)
        return
    j, k = best[1]
    right = x[rows, j] > k
    for above, part in ((False, rows[~right]), (True, rows[right])):
        more = (*path, Test(j, float(cuts[j][k]), above))
        rules.append(more)
        _grow(x, cuts, grad, hess, part, more, depth - 1, least, rules, step, rate)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, t.statistic] > t.cut) == t.above for t in rule])


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3) -> list[Rule]:
    """The distinct paths of boosted trees (logistic loss), in the order found."""
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 49))) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    score, rules = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        _grow(binned, cuts, y - p, p * (1 - p), np.arange(len(y)), (), depth, max(2, len(y) // 500), rules, step, rate)
        score += step
    return list(dict.fromkeys(rules))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) of the L1-penalised logistic regression, by accelerated
    proximal gradient steps; the intercept is not penalised."""
    n = len(y)
    a = np.hstack([np.ones((n, 1)), z])
    v = np.ones(a.shape[1])
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1
    size = 4 * n / max(1e-9, float(v @ (a.T @ (a @ v))) * 1.01)
    w = np.zeros(a.shape[1])
    w[0] = math.log((y.sum() + 1) / (n - y.sum() + 1))
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ ahead, -40, 40))) - y) / n
        new = ahead - size * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


@dataclass
class Ensemble:
    """score = sigmoid(intercept + sum of the weights of the rules that hold)."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score as one Spark expression over the ``s_`` columns."""
        odds = F.lit(self.intercept)
        for rule, weight in self.rules:
            tests = [(F.col(f"s_{STATISTICS[t.statistic]}") > t.cut) if t.above else (F.col(f"s_{STATISTICS[t.statistic]}") <= t.cut)
                     for t in rule]
            odds = odds + F.when(reduce(lambda a, b: a & b, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            odds += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-odds))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> Ensemble:
    """Rules from trees, weights from the lasso; with one class, or no rows, the
    smoothed share of label 1 for every text."""
    if not len(y) or y.min() == y.max():
        return Ensemble(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), [])
    rules = tree_rules(x, y)
    if not rules:  # too few rows to part
        return Ensemble(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), [])
    z = np.stack([_holds(r, x) for r in rules], axis=1).astype(float)
    intercept, w = lasso(z, y, penalty)
    return Ensemble(intercept, [(r, float(v)) for r, v in zip(rules, w, strict=True) if v != 0])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality") -> Ensemble:
    """Fit on at most ``sample`` labelled documents that are not held out, those
    with the smallest hash of the id, so that the driver gets at most ``sample``
    rows of statistics. Null labels are ignored; of several labels of a document the
    mean decides, ties to 1; of several documents of one id the first by its statistics counts."""
    i = F.col(doc_id).cast("long")
    marks = labels.where(F.col(label).isNotNull() & i.isNotNull() & ~held_out(i)).groupBy(i.alias("__lid")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("__y"))
    marks = marks.orderBy(F.xxhash64("__lid"), "__lid").limit(sample)  # at most ``sample`` pairs of numbers
    chosen = docs.join(F.broadcast(marks), i == F.col("__lid")).select("__lid", "__y", F.col(text).alias("__text"))
    names = [f"s_{s}" for s in STATISTICS]
    # one row per id before anything reaches the driver, however often an id occurs
    one = with_statistics(chosen, "__text", [F.col("__lid"), F.col("__y")]).groupBy("__lid", "__y").agg(F.min(F.struct(*names)).alias("s"))
    rows = one.select("__lid", "__y", "s.*").toPandas().sort_values("__lid")
    return fit(rows[names].to_numpy(np.float64), rows["__y"].to_numpy(np.float64))


def classify(docs: DataFrame, model: Ensemble, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= ``threshold``) for every row.
    Null and empty texts are scored by statistics of zero. Ids, labels, languages and
    sources are no inputs of the score. Repeated rows stay; an empty table gives an empty result."""
    i = F.col(doc_id).cast("long").alias("doc_id")
    scored = with_statistics(docs, text, [i]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Ensemble, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects; no shuffle."""
    shown = ", ".join(f"{s} double" for s in (f"s_{s}" for s in STATISTICS))

    @F.pandas_udf(shown)
    def stats(t: pd.Series) -> pd.DataFrame:
        got = [statistics((x or "").encode()) for x in t]
        return pd.DataFrame(np.array(got, np.float64).reshape(len(got), len(STATISTICS)), columns=[f"s_{s}" for s in STATISTICS])

    cols = [F.col(f"`{c}`") for c in docs.columns]
    wide = docs.select(F.struct(*cols).alias("__row"), stats(F.col(text)).alias("__s")).select("__row", "__s.*")
    return wide.where(model.column() >= threshold).select("__row.*")
