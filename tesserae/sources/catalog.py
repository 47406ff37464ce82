"""Catalog operations: namespaces, keyed tables, additive schema sync,
lakehouse session profile."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import KeySpec


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def create_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_q(name)}{loc}")


def drop_namespace(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {_q(name)} CASCADE")


def use_namespace(spark: SparkSession, name: str) -> None:
    spark.sql(f"USE {_q(name)}")


def tables_of(spark: SparkSession, name: str) -> list[str]:
    """Names of the tables in a namespace, sorted; none if there is no such namespace."""
    if not spark.catalog.databaseExists(name):
        return []
    return sorted(r["tableName"] for r in spark.sql(f"SHOW TABLES IN {_q(name)}").collect() if not r["isTemporary"])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{_q(f.name)} {f.dataType.simpleString()}" for f in schema.fields)


def create_keyed_table(spark: SparkSession, name: str, schema: T.StructType, key: KeySpec,
                       buckets: int = 16, location: str | None = None) -> None:
    """``CREATE TABLE IF NOT EXISTS`` with a compound key: bucketed by the
    partition key and sorted by the full key, so joins and aggregations on
    the partition key read co-located buckets without a shuffle. The key
    contract is stored in table properties."""
    props = json.dumps({"partition": list(key.partition), "clustering": list(key.clustering),
                        "version": list(key.version)})
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_ddl(schema)}) USING parquet "
        f"CLUSTERED BY ({', '.join(_q(c) for c in key.partition)}) "
        f"SORTED BY ({', '.join(_q(c) for c in key.primary)}) INTO {int(buckets)} BUCKETS{loc} "
        f"TBLPROPERTIES ('tesserae.key' = '{props}')"
    )


def buckets_for(input_bytes: int, bucket_bytes: int = 256 << 20, least: int = 8) -> int:
    """Buckets for a table of that size: a power of two, so tables of different sizes still line up."""
    n = least
    while n * bucket_bytes < input_bytes:
        n *= 2
    return n


def write_keyed(df: DataFrame, name: str, key: KeySpec, buckets: int, location: str, mode: str = "overwrite",
                by: str = "partition") -> None:
    """Persist a keyed table bucketed by the partition key (``by="partition"``) or by the full key
    (``by="primary"``) and sorted by the full key. Later aggregations and joins on those columns read the
    buckets already co-located (no shuffle); the files go to ``location``
    (a shared folder), never to a machine-local warehouse.

    One task reads a bucket of a join, so tables joined on the full key are bucketed by it: a partition
    key that holds a third of all rows is then spread over all buckets.

    The rows are range-partitioned by (bucket id, key) before the write, so
    each task covers a contiguous stretch of about one bucket: files stay
    about tasks + buckets instead of tasks x buckets, and a hot partition key
    is split over several tasks by its clustering columns.
    """
    cols = {"partition": key.partition, "primary": key.primary}[by]
    bucket_id = F.pmod(F.hash(*[F.col(c) for c in cols]), F.lit(int(buckets)))
    (df.repartitionByRange(bucket_id, *key.primary).write.mode(mode).format("parquet").option("path", location)
     .bucketBy(int(buckets), *cols).sortBy(*key.primary).saveAsTable(name))


def join_stored(spark: SparkSession, left: str, right: str, key: KeySpec, how: str = "inner") -> DataFrame:
    """Join of two tables stored by ``write_keyed(by="primary")`` with as many buckets, on the full
    key: bucket meets bucket, and neither table is shuffled. Small tables are not broadcast
    either, so the plan is the same at every size."""
    return spark.table(left).hint("merge").join(spark.table(right), list(key.primary), how)


def table_key(spark: SparkSession, name: str) -> KeySpec:
    rows = spark.sql(f"SHOW TBLPROPERTIES {name} ('tesserae.key')").collect()
    d = json.loads(rows[0]["value"])
    return KeySpec(tuple(d["partition"]), tuple(d["clustering"]), tuple(d.get("version", ())))


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def truncate_table(spark: SparkSession, name: str) -> None:
    """Empty a table, keeping its schema. Managed tables take ``TRUNCATE``;
    external ones (explicit path) are overwritten with an empty frame."""
    meta = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Type'").collect()
    if meta and meta[0]["data_type"].strip().upper() == "EXTERNAL":
        # in a session of its own, so that the caller's overwrite mode does not matter:
        # a dynamic overwrite with no rows would leave every partition
        other = spark.newSession()
        other.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
        full = name if "." in name else f"{spark.catalog.currentDatabase()}.{name}"
        other.createDataFrame([], spark.table(name).schema).write.mode("overwrite").insertInto(full)
        spark.catalog.refreshTable(name)
    else:
        spark.sql(f"TRUNCATE TABLE {name}")


def sync_schema(df: DataFrame, model: T.StructType) -> DataFrame:
    """Additive schema sync: columns of the model that the data lacks are
    added as typed nulls; existing columns are kept as they are (never
    dropped or retyped). Model columns come first, in model order."""
    have = set(df.columns)
    cols = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in model.fields]
    extra = [F.col(c) for c in df.columns if c not in {f.name for f in model.fields}]
    return df.select(*cols, *extra)


def _merged(a: T.DataType, b: T.DataType, where: str) -> T.DataType:
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f for f in a.fields}
        by_case = {n.lower(): n for n in fields}
        for f in b.fields:
            if f.name in fields:
                old = fields[f.name]
                fields[f.name] = T.StructField(f.name, _merged(old.dataType, f.dataType, f"{where}{f.name}."), True)
            elif f.name.lower() in by_case:
                raise ValueError(f"{where}{f.name} and {where}{by_case[f.name.lower()]} differ in case alone")
            else:
                fields[f.name] = T.StructField(f.name, f.dataType, True)
                by_case[f.name.lower()] = f.name
        return T.StructType(list(fields.values()))
    if a != b:
        raise ValueError(f"{where[:-1]}: {a.simpleString()} in one generation, {b.simpleString()} in another")
    return a


def merge_schemas(schemas: list[T.StructType]) -> T.StructType:
    """Union of the fields of all schemas, nested ones too, in order of first appearance. A field of two types, or
    two names that differ in case alone, are conflicts and raise ``ValueError``: nothing is retyped."""
    out = T.StructType([])
    for s in schemas:
        out = _merged(out, s, "")
    return out


def read_generations(spark: SparkSession, paths: list[str], model: T.StructType | None = None) -> DataFrame:
    """One read over folders of Parquet files that were written under different schemas, oldest first.

    Each generation's schema comes from its footers, all are merged once and checked (with those of ``model``, whose
    columns come first); columns that a file lacks read as null. The result is a single scan, so
    filters and column pruning reach the files of every generation. No paths: an empty frame of the model.
    """
    known = [spark.read.parquet(p).schema for p in paths]
    schema = merge_schemas(([model] if model is not None else []) + known)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def sync_table(spark: SparkSession, name: str, model: T.StructType) -> list[str]:
    """Additive sync of a stored table: adds the model's missing columns, which read
    as null in the rows already there. Returns the names added."""
    have = {c.lower() for c in spark.table(name).columns}
    new = [f for f in model.fields if f.name.lower() not in have]
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({_ddl(T.StructType(new))})")
    return [f.name for f in new]


def check_schema(df: DataFrame, schema: T.StructType, exact: bool = False) -> list[str]:
    """Differences between a frame's schema and a declared one (names and
    types; extra columns only when ``exact``). Empty list = matches."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in schema.fields:
        if f.name not in have:
            out.append(f"missing {f.name}")
        elif have[f.name] != f.dataType:
            out.append(f"{f.name}: {have[f.name].simpleString()} != {f.dataType.simpleString()}")
    if exact:
        out += [f"extra {c}" for c in have if c not in {f.name for f in schema.fields}]
    return out


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a declared schema (ANSI casts raise on bad values)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def lakehouse_profile(kind: str, warehouse: str) -> dict[str, str]:
    """Session settings for a table-format catalog. The jars are not shipped
    here; pass the dict to ``build_session(extra=...)`` where they exist."""
    if kind == "iceberg":
        return {
            "spark.sql.extensions": "org.apache.iceberg.spark.extensions.IcebergSparkSessionExtensions",
            "spark.sql.catalog.local": "org.apache.iceberg.spark.SparkCatalog",
            "spark.sql.catalog.local.type": "hadoop",
            "spark.sql.catalog.local.warehouse": warehouse,
        }
    if kind == "delta":
        return {
            "spark.sql.extensions": "io.delta.sql.DeltaSparkSessionExtension",
            "spark.sql.catalog.spark_catalog": "org.apache.spark.sql.delta.catalog.DeltaCatalog",
        }
    if kind == "hive":
        return {"spark.sql.catalogImplementation": "hive", "spark.sql.warehouse.dir": warehouse}
    raise ValueError(kind)
