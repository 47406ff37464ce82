"""Deterministic people generator in three forms with equal output:

* ``people_from_ids``  - native expressions on a key column (the fast path),
* ``people_map``       - ``mapInPandas`` partition function (iterator of batches),
* ``people_vectorized``- struct-returning ``pandas_udf`` then ``select("data.*")``.

Every value is arithmetic on the key, so SQL can reproduce it and a rerun
of a lost task yields the same rows.
"""

from __future__ import annotations

import hashlib
import socket

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PEOPLE_SCHEMA
from .scalars import pick, unit_double, uuid_text

# Generator vocabularies and constants, in order.
FIRST_NAMES = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gia", "Hugo",
               "Iris", "Jon", "Kai", "Lena", "Milo", "Nora", "Otto", "Pia"]
LAST_NAMES = ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Gum", "Hazel",
              "Ilex", "Juniper", "Kapok", "Larch", "Maple"]
SEED = "people"
BASE_TS = "2020-01-01 00:00:00"
TS_SPAN_SECS = 5 * 365 * 86400
FIRST_PRIME, LAST_PRIME, TS_PRIME, AMOUNT_PRIME = 31, 17, 7919, 7919


def _email(first: Column, last: Column, k: Column) -> Column:
    return F.concat(F.lower(first), F.lit("."), F.lower(last), k.cast("string"), F.lit("@example.org"))


def people_columns(id_col: str = "id", worker: Column | None = None, seed: str = SEED) -> list[Column]:
    """Columns of one person per key; ``seed`` keys the uuid."""
    k = F.col(id_col)
    first = pick(k, FIRST_NAMES, FIRST_PRIME)
    last = pick(k, LAST_NAMES, LAST_PRIME)
    ts = F.lit(BASE_TS).cast("timestamp_ntz") + F.make_dt_interval(
        secs=F.pmod(k * TS_PRIME, F.lit(TS_SPAN_SECS)).cast("int"))
    return [
        uuid_text(seed, k).alias("id"),
        (worker if worker is not None else F.concat(F.lit("w"), F.pmod(k, F.lit(3)).cast("string"))).alias("worker"),
        ts.alias("timestamp"),
        first.alias("first_name"),
        last.alias("last_name"),
        _email(first, last, k).alias("email"),
        F.concat(F.lit("555-"), F.lpad(F.pmod(k * 7, F.lit(10000)).cast("string"), 4, "0")).alias("phone"),
        unit_double(k, 1000.0, AMOUNT_PRIME).alias("amount"),
    ]


def people_from_ids(ids: DataFrame, id_col: str = "id", seed: str = SEED) -> DataFrame:
    """Expression generator: one person per key, no Python in the plan."""
    return ids.select(*people_columns(id_col, seed=seed))


def ids_per_row(df: DataFrame, key: str, n: int) -> DataFrame:
    """A range of ``n`` ids for every row: ``key * n .. key * n + n - 1``, unique if
    the key is; made by the tasks that read the rows."""
    start = F.col(key).cast("long") * n
    return df.select(F.explode(F.sequence(start, start + (n - 1))).alias("id"))


# ---- pandas forms (slow path, kept for the partition-function API) ----

def _people_pdf(keys: np.ndarray, worker: str | None, seed: str = SEED) -> pd.DataFrame:
    k = keys.astype(np.int64)
    first = np.array(FIRST_NAMES, dtype=object)[(k * FIRST_PRIME) % len(FIRST_NAMES)]
    last = np.array(LAST_NAMES, dtype=object)[(k * LAST_PRIME) % len(LAST_NAMES)]
    ks = k.astype(str)
    hexes = [hashlib.md5(f"{seed}{x}".encode()).hexdigest() for x in ks]
    ids = [f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}" for h in hexes]
    ts = pd.Timestamp(BASE_TS) + pd.to_timedelta((k * TS_PRIME) % TS_SPAN_SECS, unit="s")
    wk = np.full(len(k), worker, dtype=object) if worker is not None else np.char.add("w", (k % 3).astype(str)).astype(object)
    return pd.DataFrame({
        "id": ids,
        "worker": wk,
        "timestamp": ts,
        "first_name": first,
        "last_name": last,
        "email": [f"{a.lower()}.{b.lower()}{x}@example.org" for a, b, x in zip(first, last, ks)],
        "phone": ["555-" + str((x * 7) % 10000).zfill(4) for x in k],
        "amount": ((k * AMOUNT_PRIME) % 100000).astype(np.float64) * (1000.0 / 100000),
    })


def people_map(ids: DataFrame, id_col: str = "id", hostname_worker: bool = False, seed: str = SEED) -> DataFrame:
    """Partition-function generator (``mapInPandas``): batches in, rows out.

    ``hostname_worker=True`` labels rows with the executor host that made
    them, which is what the partition report is for.
    """

    def gen(batches):
        host = socket.gethostname() if hostname_worker else None
        for b in batches:
            yield _people_pdf(b[id_col].to_numpy(), host, seed)

    return ids.select(id_col).mapInPandas(gen, schema=PEOPLE_SCHEMA)


_PEOPLE_STRUCT = T.StructType(list(PEOPLE_SCHEMA.fields))


_UDFS: dict[str, object] = {}


def _people_udf(seed: str):
    if seed not in _UDFS:
        @F.pandas_udf(_PEOPLE_STRUCT)
        def people(keys: pd.Series) -> pd.DataFrame:
            return _people_pdf(keys.to_numpy(), None, seed)
        _UDFS[seed] = people
    return _UDFS[seed]


def people_struct(id_col: str = "id", seed: str = SEED) -> Column:
    """Struct column of a person (vectorised pandas UDF over Arrow batches)."""
    return _people_udf(seed)(F.col(id_col))


def people_vectorized(ids: DataFrame, id_col: str = "id", seed: str = SEED) -> DataFrame:
    return ids.withColumn("data", people_struct(id_col, seed)).select("data.*")


def people_struct_expr(id_col: str = "id") -> Column:
    """Same struct as ``people_struct`` but as native expressions."""
    return F.struct(*people_columns(id_col))
