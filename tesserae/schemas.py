"""Declared schemas and key contracts (never inferred from sample rows)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

PEOPLE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("worker", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("amount", T.DoubleType()),
])

USER_METRICS_SCHEMA = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("session_duration", T.IntegerType()),
    T.StructField("last_access", T.TimestampNTZType()),
])

LOCATION = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])
PROFILE = T.StructType([
    T.StructField("job", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", LOCATION),
])
USERS_SCHEMA = T.StructType([
    T.StructField("_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("profile", PROFILE),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("login_count", T.IntegerType()),
    T.StructField("last_login", T.StringType()),
    T.StructField("active", T.BooleanType()),
])


@dataclass(frozen=True)
class KeySpec:
    """Primary key of a keyed (wide-column) table.

    ``partition`` decides placement (hash of these columns), ``clustering``
    the order inside a partition. ``version`` are the columns that rank two
    writes of the same key (later wins), e.g. ``("ts", "seq")``.
    """

    partition: tuple[str, ...]
    clustering: tuple[str, ...] = ()
    version: tuple[str, ...] = field(default=())

    @property
    def primary(self) -> tuple[str, ...]:
        return tuple(self.partition) + tuple(self.clustering)


USER_METRICS_KEY = KeySpec(partition=("city",), clustering=("user_id",))
EDGE_KEY = KeySpec(partition=("src",), clustering=("dst",))
