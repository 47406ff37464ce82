"""File sources and sinks (CSV, Parquet, any Hadoop URI). A mutation returns a
frame; write it to a new path, never to the one it reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_CSV = {"quote": '"', "escape": '"', "nullValue": "\\N"}
_ENCODED = (("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"))


def _encoded(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, text in _ENCODED:
        c = F.replace(c, F.lit(raw), F.lit(text))
    return c


def _decoded(c: Column) -> Column:
    def piece(x: Column) -> Column:
        for raw, text in _ENCODED:
            x = F.replace(x, F.lit(text), F.lit(raw))
        return x

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), piece), "\\")


def _strings(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite", single_file: bool = False) -> str:
    """Directory of part files; ``header=False`` matches a bare ``.csv(path)``.
    Line breaks, NUL and backslashes in strings are written as ``\\n``, ``\\r``,
    ``\\0`` and a doubled backslash, so a row is one line and files stay splittable;
    null is ``\\N``."""
    out = df.coalesce(1) if single_file else df
    out = out.withColumns({c: _encoded(F.col(c)) for c in _strings(df.schema)})
    (out.write.mode(mode).options(**_CSV, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
     .option("header", str(header).lower()).csv(path))
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """CSV of ``write_csv`` with a declared schema (no inference pass over the data)."""
    df = spark.read.schema(schema).options(**_CSV).option("header", str(header).lower()).csv(path)
    return df.withColumns({c: _decoded(F.col(c)) for c in _strings(schema)})


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False,
                  partition_by: list[str] | None = None) -> str:
    """Parquet to a local path or any Hadoop URI (``hdfs://``, ``s3a://``...)."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sql_on_path(spark: SparkSession, sql_template: str, path: str, fmt: str = "parquet") -> DataFrame:
    """SQL straight off a path: ``{src}`` in the template becomes
    ``fmt.`path```."""
    return spark.sql(sql_template.format(src=f"{fmt}.`{path}`"))


def size_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path, from the file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def write_for_lookup(df: DataFrame, path: str, key: Sequence[str], also: Sequence[str] = (), row_group_bytes: int | None = None) -> str:
    """Parquet for point lookups: sorted by ranges of ``key``, with Bloom filters on its columns and on those of
    ``also`` (a secondary index). A lookup pushes its equalities into the scan, where minima and maxima, then the
    filters, rule row groups out unread; filters grow with a row group's distinct values only."""
    w = df.repartitionByRange(*key).sortWithinPartitions(*key).write.option("parquet.bloom.filter.adaptive.enabled", "true")
    for c in dict.fromkeys([*key, *also]):
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    w.parquet(path)
    return path
