"""The corpus pipeline: documents through the operators' filtering stages.

Every stage keeps docs' own columns, whatever their names, and treats each row of an
empty table, of repeated rows and of null columns as its operator's module says; what
that means for the rows that stay is told at each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontam, mix, neardup, quality, shard
from plumbline.llm.common import documents, labels, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity bands keep. Null and blank texts go; a null language has no band and stays; repeated rows stay or go together."""
    return quality.kept(docs, labels(spark, sf_dir))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Null texts are in no group and stay; of rows with one doc_id and text one stays."""
    return neardup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null texts stay; null and blank items, and items under eight words, reject nothing."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest mix that the target weights allow. A null source is one of its own; texts without a token go with their id's hash; rows of one doc_id stay or go together."""
    return mix.mixture(docs)


def uniform_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in random order, with shard and position (shard_1 ... where docs has such columns)."""
    return shard.sharded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("uniform_shards", uniform_shards),
]

#: SQL can't express the language model, the sketches or the random permutation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
