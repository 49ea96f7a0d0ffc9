"""The corpus pipeline: quality filter, near-dedup, decontamination, mixing, sharding.

Each stage gets the rows that the one before kept and returns the columns of
`documents`; the last returns the shards. Between stages the rows are written as
Parquet and read again. Rows are removed by id and text, so rows that share an id
or have none are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookflow.llm import decontamination, mixing, near_dups, quality, sharding
from bookflow.llm.common import documents, stored

#: Share of the tokens that the mixing stage keeps.
MIX_KEEP = 0.9


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among them."""
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five words, similarity 0.8)."""
    return near_dups.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that follows the target shares of source, language and topic."""
    return mixing.sampled(docs, keep=MIX_KEEP)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in shards of near equal bytes."""
    return sharding.shard(docs)[0]


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The classifier and the similarity links can't be written in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"stage-{name}")
    return docs
