"""Scalar column functions: all JVM-side expressions (codegen, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_token(c) -> Column:
    """Hash token of a key: the first 60 bits of md5 of its text, as bigint.

    Same value in any engine that has md5 (so it can be checked in SQL);
    ``fast_token`` is the cheaper form that operators use by default.
    """
    return F.conv(F.substring(F.md5(_c(c).cast("string")), 1, 15), 16, 10).cast("long")


def fast_token(c) -> Column:
    """Signed 64-bit hash token (xxhash64); Spark-only values."""
    return F.xxhash64(_c(c))


def uuid_text(seed: str, c) -> Column:
    """Deterministic uuid-shaped text from md5(seed || key)."""
    h = F.md5(F.concat(F.lit(seed), _c(c).cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def bounded_int(c, lo: int, hi: int, prime: int = 7919) -> Column:
    """Deterministic integer in [lo, hi] from a key: lo + (key*prime) mod (hi-lo+1)."""
    return (F.lit(lo) + F.pmod(_c(c) * prime, F.lit(hi - lo + 1))).cast("int")


def unit_double(c, scale: float = 1000.0, prime: int = 7919, buckets: int = 100000) -> Column:
    """Deterministic double in [0, scale) from a key."""
    return F.pmod(_c(c) * prime, F.lit(buckets)).cast("double") * (scale / buckets)


def bernoulli(c, one_in: int = 4) -> Column:
    """True for (one_in - 1) of every one_in keys (75 % for 4)."""
    return F.pmod(_c(c), F.lit(one_in)) != 0


def pick(c, words: list[str], prime: int = 31) -> Column:
    """Deterministic choice from a word list."""
    arr = F.array(*[F.lit(w) for w in words])
    return F.element_at(arr, (F.pmod(_c(c) * prime, F.lit(len(words))) + 1).cast("int"))


def upper_half(name, c) -> Column:
    """Upper-case the text for even keys (the 50/50 branch)."""
    return F.when(F.pmod(_c(c), F.lit(2)) == 0, F.upper(_c(name))).otherwise(_c(name))


def iso_text(ts) -> Column:
    """Timestamp -> ISO-8601 text without zone."""
    return F.date_format(_c(ts), ISO_FORMAT)


def iso_date(text) -> Column:
    """ISO text -> date (ANSI-safe: unparseable text gives null)."""
    return F.try_to_date(_c(text), "yyyy-MM-dd")
