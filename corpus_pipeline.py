"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of docs; the last adds shard and slot.  `run`
writes what a stage returns and reads it again for the next.

Defined cases, in all stages: a null text is an empty one, which the quality rules reject; rows of null id are rows like others;
repeated rows are copies, of which one stays; ties fall to the least doc_id, then to hashes; very long texts are taken whole; an
empty table gives an empty result; further columns are kept, but those named shard, slot, size or text_crc32 are replaced in the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontam, mixing, neardup, quality, sharding
from tracewell.llm.common import table, written

SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Classes of near duplicates and pivotal draws are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
