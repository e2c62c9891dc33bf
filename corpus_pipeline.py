"""Corpus pipeline: documents become a clean, mixed and shuffled training set.

Every stage is a function of (spark, docs, sf_dir) that works on all its predecessor kept. ``run`` writes each stage's
result as Parquet in the shared folder, reads it again as the next one's documents, and then deletes what the stage
and its predecessor left there.

Cases: each stage takes rows with nulls in any column, empty and very long texts, repeated rows and columns of any
name, as its operator's docstring states, and keeps all columns it is given; an empty table gives an empty one. Rows
without doc_id are scored, compared and shuffled like others; of those with one fingerprint one stays. Rows that share
a doc_id are one document to near-dedup. Documents without words stay until mixing, which never takes them.
"""

from pyspark.sql import DataFrame, SparkSession

from vellumine.llm import decontam, mix, quality, shard, simhash
from vellumine.llm.words import limit_arrow
from vellumine.scratch import drop, drop_since, made, written
from vellumine.tables import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, does not reject; without labels none is rejected."""
    limit_arrow(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8: the one with the smallest doc_id."""
    limit_arrow(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; all, where the benchmark is empty."""
    limit_arrow(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix.mixture(docs)


def shard_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their shard and slot."""
    return shard.shards(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", shard_out),
]

#: SQL can express neither the boosted trees nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = made()
        kept = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_since(spark, since, kept)
        drop(docs)
        docs = kept
    return docs
