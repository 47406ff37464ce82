"""Sorts, limits and top-k. Every limit carries a full tie-break so the
result is deterministic; Catalyst plans sort+limit as TakeOrderedAndProject
(per-partition top-k, then a k-row merge), never a full global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, order: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*order).limit(k)


def latest(df: DataFrame, ts: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    """First k rows by timestamp, newest first."""
    return top_k(df, k, [F.desc(ts), *[F.asc(t) for t in tie]])


def group_count(df: DataFrame, by: Sequence[str] | str, alias: str = "count") -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(alias))


def top_groups(df: DataFrame, by: str, k: int, alias: str = "count") -> DataFrame:
    """Group counts, largest first (ties by key)."""
    return top_k(group_count(df, by, alias), k, [F.desc(alias), F.asc(by)])


def collation_sort(df: DataFrame, col: str, k: int | None = None, collation: str = "en_CI",
                   tie: Sequence[str] = ()) -> DataFrame:
    """Locale-aware order, case-blind and accent-aware (``en_CI`` = strength 2);
    case variants sort together, ties broken by ``tie``."""
    o = df.orderBy(F.collate(F.col(col), collation), *tie)
    return o.limit(k) if k is not None else o


def preview(df: DataFrame, k: int = 20, order: Sequence[Column | str] = ()) -> DataFrame:
    """Bounded preview for display (a top-k when ordered)."""
    return (df.orderBy(*order) if order else df).limit(k)


def to_pandas_preview(df: DataFrame, k: int = 20, order: Sequence[Column | str] = (), max_rows: int = 10_000):
    """Display helper: at most ``k`` rows reach the driver, and a ``k`` above
    ``max_rows`` is refused; the unbounded ``toPandas()`` of a whole result is never
    taken."""
    if k > max_rows:
        raise ValueError(f"preview of {k} rows exceeds {max_rows}")
    return preview(df, k, order).toPandas()
