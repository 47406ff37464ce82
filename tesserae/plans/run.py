"""Run one registered query on a cluster and write its result.

``spark-submit --py-files tesserae.zip run_query.py <query> <input_dir> <output_path> [--cores N]``

The session is sized from the input folder's total bytes (one metadata
call to the file system) unless the cluster already sets
``spark.sql.shuffle.partitions`` explicitly.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..session import sizing
from .queries import QUERIES


def input_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def main(argv=None) -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("query", choices=sorted(QUERIES))
    ap.add_argument("input_dir")
    ap.add_argument("output")
    ap.add_argument("--cores", type=int, default=None, help="total executor cores (default: defaultParallelism)")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"tesserae-{a.query}").getOrCreate()
    if not spark.sparkContext.getConf().contains("spark.sql.shuffle.partitions"):
        cores = a.cores or spark.sparkContext.defaultParallelism
        for k, v in sizing(input_bytes(spark, a.input_dir), cores).items():
            spark.conf.set(k, v)
    QUERIES[a.query](spark, a.input_dir).write.mode("errorifexists").parquet(a.output)


if __name__ == "__main__":
    main()
