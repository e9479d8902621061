"""From raw documents to shards of a training corpus, in five stages.

Each stage takes (spark, docs, folder) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.decontaminate import drop_contaminated
from millrace.llm.mixing import mixed_documents
from millrace.llm.near_dup import drop_near_duplicates
from millrace.llm.quality_vote import keep_good
from millrace.llm.sharding import sharded_documents
from millrace.session import scratch_path

SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the votes of all rules make probably good."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in the order of the mix, repeated as often as it takes them."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with their shard and their slot in it."""
    return sharded_documents(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Estimation by repeated aggregation and label propagation have no SQL form; tests hold the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
