"""Keyed (wide-column) table operators: last-write-wins upsert, batches,
TTL, predicate delete, token-order scans and seeks, key layout."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fast_token
from ..schemas import KeySpec

_BATCH = "_batch"
_ROW = "_row"
Token = Callable[[Column], Column]


def upsert(current: DataFrame | None, changes: Sequence[DataFrame] | DataFrame, key: Sequence[str] | KeySpec,
           version: Sequence[str] = (), batch_precedence: bool = True) -> DataFrame:
    """INSERT-as-upsert with last write wins, for any number of batches.

    Later batches win over earlier ones (the current table is batch 0);
    inside one batch the largest ``version`` tuple wins (e.g. ``("ts",
    "seq")``), and equal versions fall back to the row values, so the result
    never depends on task order. The whole row is replaced: a null in the
    change overwrites a value. Output has the columns of ``current`` (or of
    the first change); version columns absent from a frame count as null.
    ``batch_precedence=False`` ranks rows by ``version`` alone, for streams
    whose batches may arrive out of order.

    One plan at every size: the changes alone are reduced to one row per key
    (partial + final ``max_by``: a hot key collapses map-side), rows of
    ``current`` with those keys are taken out by a null-safe anti join, and
    the reduced changes are appended. ``current`` is never aggregated; Spark
    broadcasts or shuffles the join by the sizes it measures at run time.
    ``current`` should hold one row per key: rows of unchanged keys are kept
    as they are, repeated ones too; a changed key ends with one row.
    """
    if isinstance(key, KeySpec):
        version = tuple(version) or key.version
        key = key.primary
    key, version = list(key), list(version)
    changes = [changes] if isinstance(changes, DataFrame) else list(changes)
    if current is None:
        return _lww(None, changes, key, version, batch_precedence)
    cols = current.columns
    latest = _lww(None, changes, key, version, batch_precedence,
                  keep=cols + [v for v in version if v not in cols], like=current, packed=True)
    # the key side asks for the packed row too: both uses are then one aggregate, and its shuffle is reused
    ks = latest.filter(F.col(_ROW).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    match = None
    for i, k in enumerate(key):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        match = c if match is None else match & c
    rest = current.join(ks, match, "left_anti")
    rows = latest.select(*[F.col(c) if c in key else F.col(f"{_ROW}.{c}").alias(c)
                           for c in cols + [v for v in version if v not in cols]])
    if batch_precedence:
        return rest.unionByName(rows.select(*cols))
    touched = current.join(ks, match, "left_semi")
    merged = _lww(touched, [rows], key, version, batch_precedence=False)
    return rest.unionByName(merged.select(*cols))


def _lww(current: DataFrame | None, changes: Sequence[DataFrame], key: list[str], version: list[str],
         batch_precedence: bool, keep: list[str] | None = None, like: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """Union-and-aggregate last write wins (see ``upsert``); ``keep`` names
    the output columns, typed from the frames or from ``like``. ``packed`` leaves
    the other columns in one struct."""
    frames = ([] if current is None else [current]) + list(changes)
    out_cols = keep or frames[0].columns
    types = {}
    for f in frames + ([like] if like is not None else []):
        for fld in f.schema.fields:
            types.setdefault(fld.name, fld.dataType)
    extra_version = [v for v in version if v not in out_cols]
    all_cols = out_cols + extra_version
    start = 0 if current is not None else 1
    tagged = None
    for i, f in enumerate(frames):
        t = f.select(*[F.col(c) if c in f.columns else F.lit(None).cast(types[c]).alias(c) for c in all_cols])
        t = t.withColumn(_BATCH, F.lit(start + i))
        tagged = t if tagged is None else tagged.unionByName(t)
    values = [c for c in out_cols if c not in key]
    if not values:
        keys = tagged.select(*key).distinct()
        return keys.withColumn(_ROW, F.struct(F.lit(1).alias("_"))) if packed else keys
    lead = [F.col(_BATCH)] if batch_precedence else []
    order = F.struct(*lead, *[F.col(v) for v in version], *[F.col(v) for v in values if v not in version])
    out = tagged.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias(_ROW))
    if packed:
        return out
    return out.select(*[F.col(c) if c in key else F.col(f"{_ROW}.{c}").alias(c) for c in out_cols])


def _time(t, default: Column) -> Column:
    if t is None:
        return default
    return t if isinstance(t, Column) else F.lit(t).cast("timestamp_ntz")


def with_ttl(df: DataFrame, ttl_seconds: int, written_at: str | Column | None = None, col: str = "expires_at",
             where: Column | None = None) -> DataFrame:
    """``USING TTL n``: rows expire ``n`` seconds after their write time (a column
    or its name; now, if none). With ``where``, only rows for which it is true;
    the others, null included, never expire."""
    w = F.col(written_at) if isinstance(written_at, str) else _time(written_at, F.localtimestamp())
    end = w + F.make_dt_interval(secs=F.lit(int(ttl_seconds)))
    return df.withColumn(col, end if where is None else F.when(where, end))


def live(df: DataFrame, as_of=None, col: str = "expires_at") -> DataFrame:
    """Rows still alive at ``as_of`` (default now): no expiry, or expiry strictly later."""
    return df.filter(F.col(col).isNull() | (F.col(col) > _time(as_of, F.localtimestamp())))


def expired(df: DataFrame, as_of=None, col: str = "expires_at") -> DataFrame:
    return df.filter(F.col(col) <= _time(as_of, F.localtimestamp()))


def delete_where(df: DataFrame, pred: Column) -> DataFrame:
    """DELETE of every row matching a non-key predicate, in one job."""
    return df.filter(~F.coalesce(pred, F.lit(False)))


def point(df: DataFrame, **key_values) -> DataFrame:
    """Lookup on the full primary key; pushed into the scan as equality filters."""
    cond = F.lit(True)
    for k, v in key_values.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)


def with_token(df: DataFrame, partition: Sequence[str], col: str = "token", token: Token = fast_token) -> DataFrame:
    """Token of the partition key (``token``: any hash function of one column)."""
    p = F.col(partition[0]) if len(partition) == 1 else F.concat_ws("\u0001", *[F.col(c).cast("string") for c in partition])
    return df.withColumn(col, token(p))


def scan_in_token_order(df: DataFrame, key: KeySpec, limit: int | None = None, token: Token = fast_token) -> DataFrame:
    """``SELECT * .. [LIMIT n]`` in the store's natural order: token of the
    partition key, then clustering columns (a top-k when limited)."""
    t = with_token(df, key.partition, "_tok", token)
    o = t.orderBy("_tok", *key.primary)
    if limit is not None:
        o = o.limit(limit)
    return o.drop("_tok")


def token_seek(df: DataFrame, key: KeySpec, start: int, token: Token = fast_token) -> DataFrame:
    """``WHERE token(pk) >= start LIMIT 1``; wraps to the smallest token when no row lies
    at or after ``start``. One aggregate: min over (wrapped, token, key) structs."""
    t = with_token(df, key.partition, "_tok", token)
    wrapped = (F.col("_tok") < F.lit(start)).cast("int")
    order = F.struct(wrapped.alias("w"), F.col("_tok").alias("t"), *[F.col(k) for k in key.primary])
    best = t.agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("_r"))
    return best.filter(F.col("_r").isNotNull()).select("_r.*")


def distinct_partitions(df: DataFrame, key: KeySpec) -> DataFrame:
    """``SELECT DISTINCT <partition key>``."""
    return df.select(*key.partition).distinct()


def clustered_layout(df: DataFrame, key: KeySpec, partitions: int | None = None) -> DataFrame:
    """Store layout: ranges of the full key, sorted inside each partition. A hot
    partition key is split over several tasks by its clustering columns."""
    cols = list(key.primary)
    r = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return r.sortWithinPartitions(*cols)
