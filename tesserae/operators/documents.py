"""Document-collection reads: filters, projections, pipelines, lookups.

Documents are rows with nested struct / array columns. Missing fields are
nulls, so SQL three-valued logic gives document-store match rules: a
comparison on a missing field matches nothing and raises nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_field(df: DataFrame, path: str) -> bool:
    """Whether a dotted path exists in the schema."""
    dt: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(dt, T.StructType) or part not in dt.fieldNames():
            return False
        dt = dt[part].dataType
    return True


def field(df: DataFrame, path: str, default=None) -> Column:
    """Value at a dotted path, or ``default`` (null) when the path is absent
    from the schema or null in the row; ``.get(f, 0)`` is ``field(df, f, 0)``."""
    if not has_field(df, path):
        return F.lit(default)
    return F.coalesce(F.col(path), F.lit(default)) if default is not None else F.col(path)


def match(df: DataFrame, *preds: Column) -> DataFrame:
    """Conjunction of predicates (``{"a": 1, "b": {"$gt": 2}}``)."""
    cond = None
    for p in preds:
        cond = p if cond is None else cond & p
    return df if cond is None else df.filter(cond)


def contains(path, value) -> Column:
    """Scalar equality against an array field matches membership."""
    return F.array_contains(_c(path), value)


def regex(path, pattern: str, ignore_case: bool = False) -> Column:
    """Regex match; a missing field does not match."""
    p = f"(?i){pattern}" if ignore_case else pattern
    return F.coalesce(_c(path).rlike(p), F.lit(False))


def count_matching(df: DataFrame, *preds: Column, alias: str = "n") -> DataFrame:
    """``count_documents(q)``: one row, one bigint. Filter then count, so the
    predicate reaches the Parquet scan (row-group skipping)."""
    return match(df, *preds).agg(F.count(F.lit(1)).alias(alias))


def project(df: DataFrame, paths: Sequence[str], exclude_id: bool = True) -> DataFrame:
    """Inclusion projection that keeps nesting: ``profile.job`` -> ``profile{job}``.

    Nested schema pruning lets the scan read only the listed leaves.
    """
    tree: dict = {}
    for p in paths:
        node = tree
        parts = p.split(".")
        for q in parts[:-1]:
            node = node.setdefault(q, {})
        node[parts[-1]] = None

    def build(prefix: str, sub: dict) -> list[Column]:
        out = []
        for name, child in sub.items():
            path = f"{prefix}.{name}" if prefix else name
            if child is None:
                out.append(F.col(path).alias(name))
            else:
                out.append(F.struct(*build(path, child)).alias(name))
        return out

    cols = build("", tree)
    if not exclude_id and "_id" not in tree and "_id" in df.columns:
        cols = [F.col("_id")] + cols
    return df.select(*cols)


def group(df: DataFrame, by: Mapping[str, Column] | Column | str, **aggs: Column) -> DataFrame:
    """``$group``: a missing key forms one null group; ``$avg`` skips nulls."""
    if isinstance(by, Mapping):
        keys = [_c(v).alias(k) for k, v in by.items()]
    else:
        keys = [_c(by).alias("_id")]
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def restructure(df: DataFrame, spec: Mapping[str, object]) -> DataFrame:
    """``$project`` with renames and nested objects: values are column names,
    Columns, or nested mappings (which become structs)."""

    def build(s: Mapping[str, object]) -> list[Column]:
        out = []
        for name, v in s.items():
            if isinstance(v, Mapping):
                out.append(F.struct(*build(v)).alias(name))
            else:
                out.append(_c(v).alias(name))
        return out

    return df.select(*build(spec))


def pipeline(df: DataFrame, stages: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Stages applied in order (match -> group -> sort -> project -> limit).

    Catalyst fuses sort + project + limit into ``TakeOrderedAndProject``.
    """
    for st in stages:
        df = df.transform(st)
    return df


def find_one(df: DataFrame, pred: Column | None, key: str = "_id") -> DataFrame:
    """First match in key order (the store's "any one" made deterministic)."""
    d = df if pred is None else df.filter(pred)
    return d.orderBy(F.asc_nulls_last(key)).limit(1)


def by_id(df: DataFrame, value, key: str = "_id") -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct columns to top-level columns ``a_b_c`` (arrays kept)."""

    def walk(prefix: str, name: str, dt: T.DataType) -> list[Column]:
        path = f"{prefix}.{name}" if prefix else name
        label = path.replace(".", sep)
        if isinstance(dt, T.StructType):
            out = []
            for f in dt.fields:
                out.extend(walk(path, f.name, f.dataType))
            return out
        return [F.col(path).alias(label)]

    cols = []
    for f in df.schema.fields:
        cols.extend(walk("", f.name, f.dataType))
    return df.select(*cols)


def insert_many(collection: DataFrame | None, docs: DataFrame, key: str = "_id",
                id_from: Sequence[str] | None = None) -> DataFrame:
    """Bulk insert: appends ``docs``; documents without ``_id`` get a uuid.

    ``id_from`` derives the uuid from those fields instead (deterministic:
    a re-run task after executor loss gives the same ids). Fields absent on
    one side become nulls (schemas are unioned by name).
    """
    if key not in docs.columns and id_from:
        from ..functions.scalars import uuid_text
        docs = docs.withColumn(key, uuid_text("doc", F.concat_ws("\u0001", *[F.col(c).cast("string") for c in id_from])))
    if key not in docs.columns:
        if collection is not None and key in collection.columns and \
                not isinstance(collection.schema[key].dataType, T.StringType):
            raise ValueError(f"collection {key} is {collection.schema[key].dataType.simpleString()}: pass ids")
        # uuid() is drawn once per committed task attempt; persist the result
        # (write or checkpoint) before reusing it in more than one action
        docs = docs.withColumn(key, F.expr("uuid()"))
    if collection is None:
        return docs
    return collection.unionByName(docs, allowMissingColumns=True)


def insert_unique(collection: DataFrame, docs: DataFrame, key: str = "_id", order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Insert that keeps ``key`` unique, as an unordered bulk insert does: ``(collection after it, rejected)``; see
    ``unique_documents``."""
    inserted, rejected = unique_documents(collection, docs, key, order)
    return collection.unionByName(inserted, allowMissingColumns=True), rejected


def unique_documents(collection: DataFrame, docs: DataFrame, key: str = "_id", order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The documents of a batch that an insert takes and those it leaves out: ``(inserted, rejected)``.

    ``rejected`` holds the documents left out with their ``reason``: ``stored`` (the key is in the collection),
    ``batch`` (an earlier document of the batch has it) or ``no key`` (null). Of equal keys the first by ``order``, then
    by a hash of the document, is taken; equal documents are told apart by their number alone. The collection's
    keys are unique by contract, and null there at most once; only its key column is read.

    The batch is folded to its distinct documents first, then to one row per key, which meets
    the collection's keys in one join; that row says which document is taken. It is written to the shared folder, so
    that the documents of a key with a third of the batch are split over tasks when they meet it.
    """
    spark, cols = docs.sparkSession, docs.columns
    at = F.struct(*[F.col(c) for c in order], F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in cols]))
    folded = docs.select(F.col(key).alias("_k"), F.struct(*cols).alias("_doc"), at.alias("_at")).groupBy("_k", "_at").agg(
        F.any_value("_doc").alias("_doc"), F.count(F.lit(1)).alias("_copies"))
    first = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), at.alias("_at")).groupBy("_k").agg(F.min("_at").alias("_first"))
    known = collection.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.lit(True).alias("_stored"))
    path = scratch_path(spark, "insert-keys")
    first.join(known, "_k", "left").select("_k", "_first", F.coalesce("_stored", F.lit(False)).alias("_stored")).write.parquet(path)
    judged = folded.join(spark.read.parquet(path), "_k", "left")
    taken = F.coalesce(~F.col("_stored") & (F.col("_at") == F.col("_first")), F.lit(False))
    reason = F.when(F.col("_k").isNull(), "no key").when(F.col("_stored"), "stored").otherwise("batch")
    left = F.col("_copies") - taken.cast("long")
    rejected = judged.filter(left > 0).select("_doc", reason.alias("reason"), F.explode(F.sequence(F.lit(1).cast("long"), left)).alias("_i"))
    return judged.filter(taken).select("_doc.*"), rejected.select(*[F.col(f"_doc.`{c}`").alias(c) for c in cols], "reason")
