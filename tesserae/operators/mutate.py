"""Document updates and deletes as pure functions (current -> next frame).

Parquet tables take no UPDATE/DELETE, so an update returns the next state of
the collection; write it to a new path to keep it.
Counters follow document-store rules: *matched* = predicate true,
*modified* = matched and the stored value actually changes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _true(pred: Column) -> Column:
    return F.coalesce(pred, F.lit(False))


def _current(df: DataFrame, name: str) -> Column:
    """Stored value of a field, null when the field is absent everywhere."""
    return F.col(name) if name in df.columns else F.lit(None)


def set_where(df: DataFrame, pred: Column, values: Mapping[str, Column | object]) -> DataFrame:
    """``update_many(pred, {"$set": values})``: fields may be new (sparse:
    null on documents that do not match)."""
    hit = _true(pred)
    # all fields in one projection: predicate and values see the stored document
    return df.withColumns({name: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(_current(df, name))
                           for name, v in values.items()})


def update_counts(df: DataFrame, pred: Column, values: Mapping[str, Column | object]) -> DataFrame:
    """One row: ``matched_count``, ``modified_count`` of ``set_where`` (one pass)."""
    hit = _true(pred)
    changed = F.lit(False)
    for name, v in values.items():
        val = v if isinstance(v, Column) else F.lit(v)
        changed = changed | ~_current(df, name).eqNullSafe(val)
    return df.agg(F.count_if(hit).alias("matched_count"), F.count_if(hit & changed).alias("modified_count"))


def first_key(df: DataFrame, pred: Column, key: str = "_id") -> DataFrame:
    """The single key ``update_one`` picks: smallest key among matches (1 row
    or none), so the follow-up join side has a proven size of one row."""
    return df.filter(_true(pred)).agg(F.min(key).alias("_pick")).filter(F.col("_pick").isNotNull())


def set_first(df: DataFrame, pred: Column, values: Mapping[str, Column | object], key: str = "_id") -> DataFrame:
    """``update_one``: set on the first match only; no match = no change, no insert."""
    pick = F.broadcast(first_key(df, pred, key))
    j = df.join(pick, F.col(key) == F.col("_pick"), "left")
    return set_where(j, F.col("_pick").isNotNull(), values).drop("_pick")


def inc(df: DataFrame, key_value, field: str, by: int = 1, key: str = "_id") -> DataFrame:
    """``update_one({_id: v}, {"$inc": {field: by}})``; a missing field starts at 0."""
    hit = F.col(key) == F.lit(key_value)
    cur = F.col(field) if field in df.columns else F.lit(None).cast("int")
    return df.withColumn(field, F.when(hit, F.coalesce(cur, F.lit(0)) + F.lit(by)).otherwise(cur))


def inc_first(df: DataFrame, pred: Column, field: str, by: int = 1, key: str = "_id") -> DataFrame:
    """Find one matching document (smallest key), then increment a field of it."""
    cur = F.coalesce(_current(df, field), F.lit(0))
    return set_first(df, pred, {field: cur + F.lit(by)}, key)


def inc_and_return(df: DataFrame, key_value, field: str, by: int = 1, key: str = "_id",
                   return_document: str = "after") -> DataFrame:
    """``find_one_and_update``: the before or after image of the one document."""
    if return_document == "before":
        return df.filter(F.col(key) == F.lit(key_value))
    return inc(df, key_value, field, by, key).filter(F.col(key) == F.lit(key_value))


def delete_where(df: DataFrame, pred: Column) -> DataFrame:
    """Keep rows where the predicate is not true (null counts as no match)."""
    return df.filter(~_true(pred))


def delete_counts(df: DataFrame, pred: Column | None = None) -> DataFrame:
    """One row: ``deleted_count``."""
    p = F.lit(True) if pred is None else _true(pred)
    return df.agg(F.count_if(p).alias("deleted_count"))


def delete_all_counts(df: DataFrame) -> DataFrame:
    """One row: documents before ``delete_many({})`` and documents left after it."""
    before = df.select(F.lit(1).alias("before"))
    left = delete_all(df).select(F.lit(0).alias("before"))
    return before.unionByName(left).agg(F.count_if(F.col("before") == 1).alias("count_before"),
                                        F.count_if(F.col("before") == 0).alias("count_after"))


def delete_all(df: DataFrame) -> DataFrame:
    """``delete_many({})``: empty frame, same schema."""
    return df.filter(F.lit(False))


def changes(before: DataFrame, after: DataFrame, key: str = "_id") -> DataFrame:
    """Read-back check of a change: one row for each key whose document differs between two states of a
    collection, with ``change`` (``added``, ``removed`` or ``changed``) and ``fields``, the fields that differ in
    a changed document, in column order; documents that are the same give no row.

    A field that one state lacks reads as null there. Each key is held once by each state, null being a key; fields
    may be nested, but not maps, which do not compare. Both states are read once and meet in one equi join.
    """
    fields = [c for c in dict.fromkeys([*before.columns, *after.columns]) if c != key]

    def packed(df: DataFrame, key_as: str, name: str) -> DataFrame:
        cells = [(F.col(f"`{c}`") if c in df.columns else F.lit(None)).alias(f"f{i}") for i, c in enumerate(fields)]
        return df.select(F.col(f"`{key}`").alias(key_as), F.struct(F.lit(1).alias("here"), *cells).alias(name))

    both = packed(before, "_key", "_old").join(packed(after, "_key_after", "_new"), F.col("_key").eqNullSafe(F.col("_key_after")), "full_outer")
    differ = [F.when(~F.col(f"_old.f{i}").eqNullSafe(F.col(f"_new.f{i}")), F.lit(c)) for i, c in enumerate(fields)]
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    named = F.array_compact(F.array(*differ)) if differ else F.array().cast("array<string>")
    out = both.select(F.when(F.col("_old").isNull(), F.col("_key_after")).otherwise(F.col("_key")).alias(key), kind.alias("change"), named.alias("fields"))
    return out.filter((F.col("change") != "changed") | (F.size("fields") > 0)).withColumn(
        "fields", F.when(F.col("change") == "changed", F.col("fields")).otherwise(F.array().cast("array<string>")))
