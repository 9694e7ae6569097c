"""The training corpus: documents through five stages, each an operator of veilstream.llm.

A stage is a function (spark, docs, sf_dir) -> DataFrame. It reads all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilstream.llm import decontamination, jaccard, mixing, quality, sharding
from veilstream.llm.common import discard, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest id."""
    return jaccard.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of sources takes them."""
    return mixing.mix_documents(docs, quality=mixing.label_weights(table(spark, sf_dir, "labels")))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of the mix."""
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix_sources),
    ("sharding", shards),
]

#: Near-duplicate classes and the mix have no equivalent in SQL; tests hold the operators against brute force, the stages against what they may keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result but the last is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = materialize(out, f"pipeline-{k}")
        if before is not None:
            discard(before)  # the next stage reads what is written now
        before = docs
    return docs
