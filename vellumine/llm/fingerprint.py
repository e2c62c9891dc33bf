"""Document fingerprints: canonical exact digests, checked byte by byte inside equal buckets.

The canonical form is Unicode NFKC, case folding, and each run of white space as one space, trimmed; the fingerprint is
the 128-bit xxh3 of its UTF-8. Documents in one bucket are compared by canonical bytes; where they differ (a collision)
the fingerprints get the SHA-256 of the canonical bytes as a suffix, so that equal fingerprints mean equal canonical
texts.

Cases: null counts as the empty text. Rows are ordered by doc_id (null first), rows with one doc_id by a hash of the
text; repeated rows stay rows. The only row of a table is its own next document. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

import hashlib
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .words import filled, slices

MAP_BITS = 27  # bits of the map of shared fingerprints: 16 MB at most


def canonical(text: str) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def wide(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many code points from the start of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _row(text: str, own: bytes, following: str, next_canonical: bytes, digest: Callable[[bytes], str]) -> tuple:
    other = edited(text, following)
    changed = canonical(other)
    sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, digest(own), digest(changed), float(own == changed), float(own == next_canonical)


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(ordered: DataFrame, digest: Callable[[bytes], str]) -> DataFrame:
    """Results for rows whose next row is in their partition; the first and last row of each partition (``part``) as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rows, part = None, [], TaskContext.get().partitionId()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("edge", pa.string()), ("part", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        for b in slices(batches, "text"):
            for doc_id, h, text in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), filled(b, "text").to_pylist(), strict=True):
                own = canonical(text)
                if before is None:
                    rows.append((doc_id, h, "first", part, text, *[None] * 6))
                else:
                    rows.append((before[0], before[1], None, None, None, *_row(before[2], before[3], text, own, digest)))
                before = (doc_id, h, text, own)
            if rows:
                yield flushed()
        if before is not None:
            rows.append((before[0], before[1], "last", part, before[2], *[None] * 6))
            yield flushed()

    return ordered.mapInArrow(run, f"doc_id long, h long, edge string, part long, text string, {COLUMNS}")


def _edges(edges: DataFrame, digest: Callable[[bytes], str]) -> DataFrame:
    """Results for the last row of each partition of the sort, joined to the first row of the next one that has rows.

    Only numbers of partitions are put into one order; their texts meet two by two.
    """
    last, first = edges.filter("edge = 'last'"), edges.filter("edge = 'first'").select(F.col("part").alias("then"), F.col("text").alias("following"))
    parts = [r.part for r in last.select("part").orderBy("part").collect()]  # a number for each partition of one sort
    follows = edges.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part long, then long")
    put = last.select("doc_id", "h", "text", "part").join(follows, "part").join(first, "then").select("doc_id", "h", "text", "following")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_row(t, canonical(t), n, canonical(n), digest) for t, n in zip(b.column("text").to_pylist(), b.column("following").to_pylist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *map(pa.array, zip(*found, strict=True))], ["doc_id", "h", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return put.mapInArrow(run, f"doc_id long, h long, {COLUMNS}")


def _shared_bits(found: DataFrame) -> tuple[int, dict[int, bytes]]:
    """A bitmap of hashed fingerprints that several rows have: about 64 bits each, 2^MAP_BITS at most."""
    shared = written(found.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint"), "shared")
    mask = (1 << min(MAP_BITS, max(15, (64 * shared.count()).bit_length()))) - 1
    bit = shared.select(F.crc32("fingerprint").bitwiseAND(F.lit(mask)).alias("bit")).distinct()
    dealt = bit.select(F.shiftright("bit", 15).alias("k"), F.col("bit").bitwiseAND(F.lit(32767)).alias("at")).repartition("k")  # so that a piece of the map is made once
    return mask, {r.k: bytes(r.bits) for r in dealt.groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits")).collect()}


def _told_apart(keyed: DataFrame, found: DataFrame, digest: Callable[[bytes], str]) -> DataFrame:
    """Compares the canonical bytes of every bucket of two rows or more and marks those of different bytes.

    Only texts whose fingerprint may be shared are shuffled, packed without loss: packed bytes are equal if and only
    if the canonical bytes are.
    """
    shared = found.sparkSession.sparkContext.broadcast(_shared_bits(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, maps = shared.value
        for b in slices(batches, "text"):
            rows = []
            for doc_id, h, text in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), filled(b, "text").to_pylist(), strict=True):
                whole = canonical(text)
                mark = digest(whole)
                bit = zlib.crc32(mark.encode()) & mask
                if (own := maps.get(bit >> 15)) and own[(bit & 32767) >> 3] >> (bit & 7) & 1:
                    rows.append((doc_id, h, mark, zlib.compress(whole, 1), hashlib.sha256(whole).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True)], ["doc_id", "h", "fingerprint", "packed", "s"])

    texts = keyed.mapInArrow(run, "doc_id long, h long, fingerprint string, packed binary, s string")
    mixed = written(texts.groupBy("fingerprint").agg(F.min("packed").alias("a"), F.max("packed").alias("b")).filter("a <> b").select("fingerprint"), "mixed")
    if mixed.isEmpty():
        return found.drop("h")
    suffix = texts.join(mixed, "fingerprint").select(F.col("doc_id").alias("i"), F.col("h").alias("j"), "s").distinct()
    return found.join(suffix, [F.col("doc_id").eqNullSafe(F.col("i")), F.col("h") == F.col("j")], "left").withColumn("fingerprint", F.concat_ws("-", "fingerprint", "s")).drop("h", "i", "j", "s")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], str] = wide) -> DataFrame:
    """One row for each document: ``doc_id`` and ``COLUMNS``. The texts are shuffled once, to order them by doc_id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    ordered = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    pairs = written(_pairs(ordered, digest), "pairs")
    whole = pairs.filter("edge is null").select("doc_id", "h", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    ends = _edges(pairs.filter("edge is not null").select("doc_id", "h", "edge", "part", "text"), digest)
    return _told_apart(keyed, whole.unionByName(ends), digest)
