"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bookflow.llm import chat, decontamination, html, lines, mixing, near_dups, oracles, periods, prefixes, quality, secrets, sharding, suffixes, telephony
from bookflow.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))[0]


@query
def op5_raking_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


ORACLES["op5_raking_mix"] = mixing.oracle()


@query
def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


@query
def op7_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.audio(documents(spark, sf_dir))


@query
def op8_layered_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir)).drop("findings")


@query
def op1_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op3_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir), width=3, percent=85).drop("text_hash")


@query
def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.scored(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op2_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(documents(spark, sf_dir), keep_text=False)


@query
def op10_deletion_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir))


ORACLES["op10_deletion_lines"] = lines.ORACLE


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@query
def op11_incremental_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.summary(conversations(spark, sf_dir).select("conv_id", "turn", "role", "text").unionByName(chat.hostile(spark)))


@query
def op12_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.summary(periods.periodic_runs(periods.planted(documents(spark, sf_dir))))


@query
def op13_family_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(conversations(spark, sf_dir)).drop("node")


ORACLES |= {"op11_incremental_rendering": chat.ORACLE, "op12_harmonic_runs": periods.oracle(), "op13_family_trie": prefixes.oracle()}
ORACLES |= {"op2_previous_factors": oracles.SUFFIXES, "op3_tensored_minhash": oracles.NEAR_DUPS, "op4_template_leaks": oracles.LEAKS}
