"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records by a seeded hash into buckets that fit in memory; pass two runs Fisher-Yates (Spark's
``shuffle``) over each bucket and writes it. The buckets one after the other are the shuffled order; shards are its
equal runs, so their row counts are at most one apart (law ``rows``).

Cases: rows with nulls, empty or very long texts are records like any other. Records that are equal in all columns
fall into one bucket; a bucket that this makes too large is split by row number within its input partition, so a
group of any size is dealt out. An empty table gives an empty result. All columns are kept, whatever their names,
but for an old ``shard`` or ``slot``, which are replaced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

SHARDS, BUCKET_BYTES, OVERHEAD, SEED = 40, 8 << 20, 16, 20_240_817
BUCKETS_A_TASK = 4
MOST_BROADCAST = 500_000  # buckets whose offsets (24 bytes each) are broadcast; beyond it they are joined


def record_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def shuffled(records: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("doc_id", "text"), seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``bucket, part, place, record``: each record (a struct) at its place in its shuffled bucket; a written table."""
    size = record_bytes(F.col(text_col))
    total = records.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n))
    loads = records.groupBy(bucket.alias("bucket")).agg(F.sum(size).alias("load"))
    hot = written(loads.filter(F.col("load") > 4 * max(bucket_bytes, total // n)).select("bucket", F.ceil(F.col("load") / bucket_bytes).cast("long").alias("parts")), "hot")
    dealt = records.select(F.struct(*records.columns).alias("record"), bucket.alias("bucket"), F.xxhash64(F.lit(seed + 1), *keys).alias("key"))
    by = ["bucket"]
    if not hot.isEmpty():
        numbered, by = dealt.withColumn("number", F.monotonically_increasing_id()).join(hot, "bucket", "left"), ["bucket", "part"]
        dealt = numbered.withColumn("part", F.coalesce(F.pmod(F.xxhash64("number"), "parts"), F.lit(0)).cast("long")).drop("number", "parts")
    tasks = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")) if n > 8 else 1, -(-n // BUCKETS_A_TASK))
    scattered = dealt.repartition(tasks, *by).sortWithinPartitions(*by, "key")
    whole = scattered.groupBy(*by).agg(F.collect_list("record").alias("records"))  # in the same stage
    mixed = whole.withColumn("records", F.shuffle("records", F.lit(seed)))
    if len(by) == 1:
        mixed = mixed.withColumn("part", F.lit(0).cast("long"))
    return written(mixed.select("bucket", "part", F.posexplode("records").alias("place", "record")), "shuffled")


def shards(records: DataFrame, n_shards: int = SHARDS, text_col: str = "text", keys: tuple[str, ...] = ("doc_id", "text"), seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``records`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard), which replace columns
    of these names."""
    mixed = shuffled(records, text_col, keys, seed, bucket_bytes)
    counts = written(mixed.groupBy("bucket", "part").agg(F.count("*").alias("n")), "counts")
    total, buckets = counts.agg(F.sum("n"), F.count("*")).first()
    starts = counts.selectExpr("bucket", "part", "sum(n) over (order by bucket, part) - n as start")  # one row a bucket
    placed = mixed.join(F.broadcast(starts) if buckets <= MOST_BROADCAST else starts, ["bucket", "part"])
    placed = placed.withColumn("at", F.col("start") + F.col("place"))
    placed = placed.withColumn("shard", F.expr(f"cast(((at + 1) * {n_shards} - 1) div {total or 1} as int)"))
    placed = placed.withColumn("slot", F.expr(f"at - (shard * {total or 0}L) div {n_shards}"))
    return placed.select(*[F.col("record")[c].alias(c) for c in records.columns if c.lower() not in ("shard", "slot")], "shard", "slot")


def write_shards(records: DataFrame, path: str, **options) -> None:
    """Writes a folder for each shard; rows lie in order of ``slot`` within each file."""
    shards(records, **options).repartition("shard", F.expr("slot div 50000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
