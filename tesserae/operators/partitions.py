"""Point changes to a stored collection that rewrite only the partitions they touch.

A collection lies in hash buckets of its key, one folder each. A change finds the
buckets that hold matches, writes their next state to a new path and leaves all others
where they are; an insert writes the new documents alone, so a bucket may lie in several
paths. The value returned says which bucket is read from which paths. Nothing
is overwritten, and there is no log: a failed change leaves the old value valid.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import mutate
from .documents import unique_documents

BUCKET = "_bucket"


@dataclass(frozen=True)
class Stored:
    """A stored collection: its schema, key, number of buckets, and the buckets read from each path."""

    schema: T.StructType
    key: str
    buckets: int
    parts: tuple[tuple[str, tuple[int, ...]], ...]


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, key: str) -> None:
    """Ranges of (bucket, key): each task writes about one bucket, a large bucket takes several."""
    df.repartitionByRange(BUCKET, key).sortWithinPartitions(BUCKET, key).write.partitionBy(BUCKET).parquet(path)


def store(df: DataFrame, path: str, key: str = "_id", buckets: int = 64) -> Stored:
    """Write ``df`` to ``path`` in ``buckets`` folders by the hash of its key."""
    _write(df.withColumn(BUCKET, bucket_of(key, buckets)), path, key)
    return Stored(df.schema, key, buckets, ((path, tuple(range(buckets))),))


def _load(spark: SparkSession, stored: Stored, only: set[int] | None = None) -> DataFrame:
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in stored.schema.fields], T.StructField(BUCKET, T.IntegerType())])
    frames = []
    for path, buckets in stored.parts:
        wanted = [b for b in buckets if only is None or b in only]
        if wanted:
            df = spark.read.schema(schema).parquet(path)
            frames.append(df if len(wanted) == stored.buckets else df.filter(F.col(BUCKET).isin(wanted)))
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def load(spark: SparkSession, stored: Stored) -> DataFrame:
    """The whole collection, each bucket from the path that holds its latest state."""
    return _load(spark, stored).drop(BUCKET)


def by_key(spark: SparkSession, stored: Stored, value) -> DataFrame:
    """The document of one key: one bucket's folder is listed and read."""
    bucket = _bucket_of_value(spark, stored, value)
    return _load(spark, stored, {bucket}).filter(F.col(stored.key) == F.lit(value)).drop(BUCKET)


def _bucket_of_value(spark: SparkSession, stored: Stored, value) -> int:
    typed = F.lit(value).cast(stored.schema[stored.key].dataType).alias(stored.key)
    return spark.range(1).select(typed).select(bucket_of(stored.key, stored.buckets)).first()[0]


def rewrite(spark: SparkSession, stored: Stored, path: str, pred: Column, change: Callable[[DataFrame], DataFrame],
            only: set[int] | None = None) -> tuple[Stored, list[int]]:
    """Apply ``change`` to every bucket with a row that matches ``pred``, writing those buckets' next state to ``path``.

    Returns the collection after it and the buckets rewritten (none: nothing is
    written). ``change`` must leave other rows as they are and keep the key; it may add columns,
    which are null in the rows of other buckets. ``only`` names buckets that alone can match.
    Of the search, at most the bucket numbers reach the driver.
    """
    hits = _load(spark, stored, only).filter(F.coalesce(pred, F.lit(False))).select(BUCKET).distinct()
    touched = sorted(r[0] for r in hits.collect())
    if not touched:
        return stored, []
    after = change(_load(spark, stored, set(touched)).drop(BUCKET))
    _write(after.withColumn(BUCKET, bucket_of(stored.key, stored.buckets)), path, stored.key)
    known = {f.name for f in stored.schema.fields}
    schema = T.StructType([*stored.schema.fields, *[f for f in after.schema.fields if f.name not in known]])
    rest = [(p, tuple(b for b in bs if b not in touched)) for p, bs in stored.parts]
    parts = (*[(p, bs) for p, bs in rest if bs], (path, tuple(touched)))
    return replace(stored, schema=schema, parts=parts), touched


def inc(spark: SparkSession, stored: Stored, path: str, value, field: str, by: int = 1) -> tuple[Stored, list[int]]:
    """``update_one({_id: value}, {"$inc": {field: by}})``: only the key's bucket is read and written."""
    return rewrite(spark, stored, path, F.col(stored.key) == F.lit(value),
                   lambda d: mutate.inc(d, value, field, by, stored.key), {_bucket_of_value(spark, stored, value)})


def set_where(spark: SparkSession, stored: Stored, path: str, pred: Column, values: Mapping) -> tuple[Stored, list[int]]:
    """``update_many``: buckets without a match stay where they are."""
    return rewrite(spark, stored, path, pred, lambda d: mutate.set_where(d, pred, values))


def set_first(spark: SparkSession, stored: Stored, path: str, pred: Column, values: Mapping) -> tuple[Stored, list[int]]:
    """``update_one``: the match of the smallest key, in one bucket; no match changes nothing."""
    pick = mutate.first_key(_load(spark, stored), pred, stored.key).first()
    if pick is None:
        return stored, []
    hit = F.col(stored.key) == F.lit(pick[0])
    return rewrite(spark, stored, path, hit, lambda d: mutate.set_where(d, hit, values), {_bucket_of_value(spark, stored, pick[0])})


def delete_where(spark: SparkSession, stored: Stored, path: str, pred: Column) -> tuple[Stored, list[int]]:
    """Delete every match; a bucket left empty has no folder and reads as empty."""
    return rewrite(spark, stored, path, pred, lambda d: mutate.delete_where(d, pred))


def insert_unique(spark: SparkSession, stored: Stored, path: str, docs: DataFrame, order: Sequence[str] = ()
                  ) -> tuple[Stored, list[int], DataFrame]:
    """Insert that keeps the key unique: ``(collection after it, buckets with new documents, rejected documents)``.

    Of what is stored, only the key column of the batch's buckets is read, and nothing is rewritten: the documents
    taken are written to ``path`` (none: nothing is), and their buckets are read from there too, until a change
    or ``compact`` writes them anew. ``docs`` may lack stored fields and add new ones, but not change
    a field's type (``ValueError``). See ``documents.unique_documents`` for which documents are taken.
    """
    known = {f.name: f.dataType for f in stored.schema.fields}
    for f in docs.schema.fields:
        if f.name in known and f.dataType != known[f.name]:
            raise ValueError(f"{f.name}: {f.dataType.simpleString()} in the batch, {known[f.name].simpleString()} stored")
    keyed = docs.filter(F.col(stored.key).isNotNull())
    near = {r[0] for r in keyed.select(bucket_of(stored.key, stored.buckets).alias(BUCKET)).distinct().collect()}
    taken, rejected = unique_documents(_load(spark, stored, near).select(stored.key), docs, stored.key, order)
    _write(taken.withColumn(BUCKET, bucket_of(stored.key, stored.buckets)), path, stored.key)
    schema = T.StructType([*stored.schema.fields, *[f for f in docs.schema.fields if f.name not in known]])
    after = replace(stored, schema=schema, parts=((path, tuple(range(stored.buckets))),))
    new = sorted(r[0] for r in _load(spark, after).select(BUCKET).distinct().collect())
    return (replace(after, parts=(*stored.parts, (path, tuple(new)))) if new else stored), new, rejected


def compact(spark: SparkSession, stored: Stored, path: str) -> tuple[Stored, list[int]]:
    """Write the buckets that lie in several paths to one path each; the others stay where they are."""
    paths = Counter(b for _, buckets in stored.parts for b in buckets)
    several = {b for b, n in paths.items() if n > 1}
    return rewrite(spark, stored, path, F.lit(True), lambda d: d, several) if several else (stored, [])
