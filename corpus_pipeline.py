"""Corpus pipeline: quality, near duplicates, benchmark leaks, source weights, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import decontam, hilbert, mixing, rule_ensemble, simhash
from tesserae.llm.common import scratch, table

#: Target weights in bytes of text; sources not named here share MIX_REST.
MIX_WEIGHTS = {"src0": 0.25, "src1": 0.08, "src2": 0.08, "src3": 0.06, "src4": 0.06}
MIX_REST = 0.47
SHARDS = 24
SHARD_DIMENSIONS = (hilbert.Dimension("source"), hilbert.Dimension("lang"), hilbert.Dimension("n_chars", numeric=True))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, distance=3, k=3, seed=42)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, MIX_WEIGHTS, rest=MIX_REST).select(*[f"`{c}`" for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hilbert.shard(docs, list(SHARD_DIMENSIONS), shards=SHARDS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The quality model and XXH64 fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each stage's rows are written as
    Parquet to the shared folder and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
