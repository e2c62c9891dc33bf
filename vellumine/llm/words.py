"""Words of Arrow text columns, split in C++ or numpy; runs in Python workers."""

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20  # so much text is worked on at a time; one longer text is a slice of its own
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20  # of Arrow batches between Spark and Python


def limit_arrow(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes in this session, unless the user has set their size.

    For queries and pipelines to call: operators work under any setting and leave the session as it is, but hold a
    batch of Spark's own size (10,000 rows, 64 MB) where this is not done.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # Spark's own
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns what Arrow and the C library hold free to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def byte_offsets(texts: pa.Array) -> np.ndarray:
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of text, however they come: a piece ends with the row that fills it."""
    held, size = [], 0
    for b in slices(batches, column, max(1, most // 8)):
        held.append(b)
        size += pc.sum(pc.binary_length(b.column(column))).as_py() or 0
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def ascii_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space of texts without nulls: all words in order, and each word's row."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), rows[full.to_numpy(zero_copy_only=False)]


def filled(batch: pa.RecordBatch, column: str) -> pa.Array:
    return pc.fill_null(batch.column(column), "")


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, with underscores before those that ``columns`` has already."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
