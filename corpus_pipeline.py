"""A training corpus out of documents: five stages, each one of the llm operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns what it keeps; all but the last return the columns of documents:

1. toxicity: documents scored as toxic go
2. near-dedup: of each group of near copies (SimHash groups, completed to five-word
   shingles at a Jaccard similarity of 0.8 or more) one document stays
3. benchmark decontamination: contaminated documents go
4. mixing: every document comes as often as the mix of sources takes it
5. sharding: documents get ``shard`` and ``slot``, equal texts together

Nulls, ties, empty texts and empty tables are as each operator defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcore.llm import decontam, mixing, near_copies, sharding, toxicity
from panelcore.llm.common import table
from panelcore.session import scratch_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_rows(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_per_group(docs, words=5, similarity=0.8)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded_rows(docs, shards=24)


STAGES = [
    ("toxicity", without_toxic),
    ("near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]

#: A learned score, verified similarity and a heap are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
