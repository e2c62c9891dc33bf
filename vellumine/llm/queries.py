"""The query of each operator over its whole table, with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import decontam, fingerprint, html_main, lm, mix, quality, quotes, shard, simhash, warc
from .words import limit_arrow


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_all(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.shards(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit(""))).cast("long")
    return placed.select("doc_id", shard.record_bytes(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.shares(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no quotes, so its turns are first written as mails that quote the two turns before them."""
    mails = quotes.as_mail(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return quotes.conversations(mails)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _limited(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        limit_arrow(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _limited(f) for f in (op1_lm_scoring, op2_sharding, op3_source_mixing, op4_quality_classifier, op5_benchmark_decontamination, op6_html_extraction, op7_document_fingerprints, op8_chat_formatting, op9_warc, op10_simhash_near_dedup)}
