"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import whole_row

#: Hash bits behind a uniform draw; u = value / 2**52 is exact in a double.
_HEX = 13


def uniform(doc_id: Column, salt: str) -> Column:
    """Hash-seeded uniform number in [0, 1) per id. A null id draws like the text 'null'."""
    text = F.concat(F.lit(salt + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, _HEX), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_bands(rates: DataFrame) -> DataFrame:
    """(__g, rate, __first, __cdf): P(X <= k) for k = __first, __first + 1, ... of the Poisson distribution of each
    rate, within 12 standard deviations and 30 of its mean; what lies outside is below 1e-30.

    Each k is a row, and sums run along them, so the work grows with the root of the rate. Terms are
    built in logarithms from the first on and scaled to a sum of one, so large rates neither underflow nor need k!.
    """
    mean, far = F.col("rate"), 12 * F.sqrt("rate") + 30
    k = rates.withColumn("__first", F.greatest(F.lit(0), F.floor(mean - far)).cast("long")).withColumn(
        "__k", F.explode(F.sequence(F.col("__first"), F.when(mean > 0, F.ceil(mean + far).cast("long")).otherwise(0))))
    whole = Window.partitionBy("__g", "rate", "__first")
    upto = whole.orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("__k") > F.col("__first"), F.log(mean) - F.log(F.col("__k").cast("double"))).otherwise(0.0)
    k = k.withColumn("__log", F.sum(step).over(upto))
    k = k.withColumn("__p", F.exp(F.col("__log") - F.max("__log").over(whole)))
    k = k.withColumn("__c", F.sum("__p").over(upto) / F.sum("__p").over(whole))
    return k.groupBy("__g", "rate", "__first").agg(F.array_sort(F.collect_list(F.struct("__k", "__c"))).alias("__all")).select(
        "__g", "rate", "__first", F.col("__all.__c").alias("__cdf"))


def rates(docs: DataFrame, weights: dict[str, float], rest: float, source: str = "source",
          text: str = "text", epochs: float = 1.0) -> DataFrame:
    """(__g, rate, __first, __cdf): one row per listed source that has text, and one (null)
    for all others; the last two as in ``poisson_bands``.

    The mean repetition rate of a source is weight / (sum of the weights present)
    * epochs * (bytes of all sources) / (bytes of the source). The table has at
    most len(weights) + 1 rows, whatever the corpus.
    """
    if any(not math.isfinite(w) or w < 0 for w in [*weights.values(), rest]):
        raise ValueError("weights must be finite and not negative")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    sizes = docs.select(_group(F.col(source), weights).alias("__g"), size.alias("n")).groupBy("__g").agg(
        F.sum("n").alias("n")).where("n > 0")
    named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    weight = F.coalesce(named[F.col("__g")], F.lit(float(rest))) if weights else F.lit(float(rest))
    sizes = sizes.withColumn("w", weight)
    everything = Window.partitionBy(F.lit(0))  # over those few rows
    sizes = sizes.select("__g", "n", "w", F.sum("n").over(everything).alias("all_n"), F.sum("w").over(everything).alias("all_w"))
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * epochs * F.col("all_n") / F.col("n")).otherwise(0.0)
    return poisson_bands(sizes.select("__g", rate.alias("rate")))


def _group(source: Column, weights: dict[str, float]) -> Column:
    return F.when(source.isin(list(weights)), source) if weights else F.lit(None).cast("string")


def mix(docs: DataFrame, weights: dict[str, float], rest: float = 1.0, epochs: float = 1.0, seed: int = 42,
        doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with every document repeated so that sources reach their target
    weights, in globally shuffled order.

    Method: per source the mean repetition rate follows from its weight and bytes;
    a uniform number hashed from the id is put through the inverse Poisson
    distribution of that mean; the document is exploded by that count; copies are
    dealt out and sorted by a hash of (seed, id, copy). No draw depends on where a
    row lies, so tasks that run again give the same rows.

    ``weights``: source -> weight; sources not listed (null too) share ``rest``.
    Weights count bytes of text. Adds ``copy`` (from 0), ``n_copies``, ``rate`` and
    ``shuffle_key`` (16 hex digits, ascending within each partition), replacing
    input columns of those names.

    Null or empty texts have no bytes: they take the rate of their group; a group
    without any bytes gives no rows. Repeated rows draw the same count each. An
    empty table gives an empty result.
    """
    made = ("copy", "n_copies", "rate", "shuffle_key")
    rate = rates(docs, weights, rest, source, text, epochs)
    rows = docs.select(whole_row(docs, made), F.col(doc_id).alias("__id"), _group(F.col(source), weights).alias("__g"))
    # at most len(weights) + 1 rows on the broadcast side
    rows = rows.join(F.broadcast(rate.withColumnRenamed("__g", "__h")), F.expr("__g <=> __h"))
    u = uniform(F.col("__id"), f"{seed}:count")
    below = F.size(F.filter("__cdf", lambda c: c <= u))
    rows = rows.select("__row", "__id", "rate", (F.col("__first") + below).cast("int").alias("n_copies"))
    # in two steps, so that no array is as long as a very large count
    rows = rows.where("n_copies > 0").withColumn("__block", F.explode(F.sequence(F.lit(0), F.shiftright(F.col("n_copies") - 1, 16))))
    last = F.least(F.col("n_copies") - 1, F.col("__block") * 65536 + 65535)
    rows = rows.select("__row", "__id", "rate", "n_copies", F.explode(F.sequence(F.col("__block") * 65536, last)).alias("copy"))
    key = F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col("__id").cast("string"), F.lit("null")),
                                        F.col("copy").cast("string"))), 1, 16)
    rows = rows.withColumn("shuffle_key", key)
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(
        "__row.*", "copy", "n_copies", "rate", "shuffle_key")
