"""Benchmark decontamination: a broadcast hash set of the items' word n-grams, scanned over all document windows.

Cases: a null or empty document has no words and no hits; null or wordless items have no windows. An item with fewer
than n words is one window of its own length. Items that share an id are one item; an item without an id marks
words but is not listed. Repeated rows stay rows; other columns, whatever their names, are passed through. Empty
tables give empty results, and an empty benchmark gives no hits.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, written
from .words import ascii_words, byte_offsets, filled, fresh, slices

WINDOW = 10
BLOCK_BYTES = 8 << 20  # most benchmark text in one broadcast set (some 30 bytes a word); more is scanned in further blocks
PIECE_WORDS = 100_000  # longer items are cut into pieces that overlap by a window less a word


def _word_table() -> np.ndarray:
    """Bytes of words (ASCII letters and digits, all of non-ASCII characters), A-Z lowered; white space for the rest."""
    t = np.full(256, 0x20, np.uint8)
    for lo, hi, add in ((0x30, 0x39, 0), (0x41, 0x5A, 0x20), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
        t[lo : hi + 1] = np.arange(lo, hi + 1) + add
    return t


def norm_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Normalised words of texts without nulls, and each word's row."""
    at = byte_offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    flat = pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(_word_table()[data].tobytes()))
    return ascii_words(flat, lower=False)


class GramSet:
    """Windows of the items: for each length, sorted hashes, where in the items' words each window stands, and its items."""

    def __init__(self, ids: list, texts: list[str], window: int = WINDOW):
        words, rows = norm_words(pa.array(texts, pa.string()))
        self.vocab = words.unique()
        self.codes = pc.index_in(words, value_set=self.vocab).to_numpy(zero_copy_only=False).astype(np.int32)
        self.names = [i for i in dict.fromkeys(ids) if i is not None]
        place = {x: k for k, x in enumerate(self.names)}
        owner = np.array([place.get(i, -1) for i in ids], np.int64)[rows] if len(rows) else np.empty(0, np.int64)
        n_words = np.bincount(rows, minlength=len(texts))[rows] if len(rows) else np.empty(0, np.int64)
        left = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(texts)))))[rows + 1] - np.arange(len(rows))
        sizes = np.minimum(window, n_words)
        starts = {int(size): np.flatnonzero((sizes == size) & (left >= size)) for size in np.unique(sizes)}
        for seed in range(100):  # other multipliers, should two windows share a hash
            self.powers = np.random.default_rng(seed).integers(1, 2**63, window, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            self.tables = {size: self._table(size, at, owner) for size, at in starts.items()}
            if not any(t is None for t in self.tables.values()):
                break
        else:
            raise RuntimeError("windows share a hash whatever the multipliers")

    def _table(self, size: int, at: np.ndarray, owner: np.ndarray):
        """Hashes of the distinct windows that begin at ``at``, a place of each, where its items begin, and the items."""
        hashes = self.hash(self.codes, at, size)
        order = np.lexsort((owner[at], hashes))
        hashes, at = hashes[order], at[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        if not self.equal(self.codes, at[1:][~new[1:]], at[:-1][~new[1:]], size).all():
            return None
        own = owner[at]
        listed = (own >= 0) & (new | np.concatenate(([True], own[1:] != own[:-1])))
        distinct = np.cumsum(new) - 1
        per = np.bincount(distinct[listed], minlength=int(new.sum()))
        return hashes[new], at[new], np.concatenate(([0], np.cumsum(per))), own[listed]

    def hash(self, codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            out += (codes[at + k].astype(np.uint64) + np.uint64(1)) * self.powers[k]
        return out

    def equal(self, codes: np.ndarray, at: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
        """If the window of ``codes`` at each of ``at`` is that of the items' words at ``own``."""
        same = np.ones(len(at), bool)
        for k in range(size):
            same &= codes[at + k] == self.codes[own + k]
        return same

    def scan(self, texts: pa.Array):
        """For each text: words, and which are hit; pairs (text, item)."""
        words, rows = norm_words(texts)
        codes = pc.fill_null(pc.index_in(words, value_set=self.vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.concatenate(([0], np.cumsum(codes < 0)))
        edge, found = np.zeros(len(codes) + 1, np.int64), [np.empty((2, 0), np.int64)]
        for size, (hashes, places, ptr, items) in self.tables.items():
            if size > len(codes):
                continue
            at = np.flatnonzero((missing[size:] == missing[: len(codes) - size + 1]) & (rows[size - 1 :] == rows[: len(codes) - size + 1]))
            for part in np.array_split(at, len(at) // 100_000 + 1):
                h = self.hash(codes, part, size)
                pos = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                part, pos = part[hashes[pos] == h], pos[hashes[pos] == h]
                ok = self.equal(codes, part, places[pos], size)  # the verification of the hit
                part, pos = part[ok], pos[ok]
                np.add.at(edge, part, 1)
                np.add.at(edge, part + size, -1)
                if not len(part):
                    continue
                row, pos = np.unique(np.stack((rows[part], pos)), axis=1)  # a window that a text repeats counts its items once
                n = ptr[pos + 1] - ptr[pos]
                own = items[np.repeat(ptr[pos] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                found.append(np.unique(np.stack((np.repeat(row, n), own)), axis=1))
        return rows, np.cumsum(edge[:-1]) > 0, np.unique(np.concatenate(found, axis=1), axis=1)


def _pieces(bench: DataFrame, window: int, id_col: str, text_col: str, piece: int = PIECE_WORDS) -> DataFrame:
    """``i, t``: the items' words, those of long items in pieces that have all their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            words, rows = norm_words(filled(b, "t"))
            edges = np.searchsorted(rows, np.arange(b.num_rows + 1))
            for r in np.flatnonzero(np.diff(edges)).tolist():
                a, end = int(edges[r]), int(edges[r + 1])
                texts = [" ".join(words[at : min(end, at + piece + window - 1)].to_pylist()) for at in range(a, max(a + 1, end - window + 1), piece)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r] * len(texts))), pa.array(texts, pa.string())], ["i", "t"])

    items = bench.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null")
    return items.mapInArrow(run, items.schema)


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` and, last, three more (``_n_words, _hits, _items``, if these names are free): word count, runs of
    hit words as [from, to, from, to ...] word positions, and ids of the items that occur.

    The benchmark's size is measured first. Up to ``block_bytes`` of text make one broadcast set. A larger benchmark
    is dealt into blocks by item or piece of one, one scan each, with results so far written between scans.
    """
    spark = docs.sparkSession
    items = written(_pieces(bench, window, item_id, item_text, min(PIECE_WORDS, max(1, block_bytes // 64))), "items")
    n = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    names = fresh(docs.columns, "_n_words", "_hits", "_items")
    empty = (F.lit(0).cast("long"), F.array().cast("array<long>"), F.array().cast(f"array<{dict(bench.dtypes)[item_id]}>"))
    out = docs.withColumns(dict(zip(names, empty, strict=True)))
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        rows = sorted(block.collect(), key=str)
        grams = spark.sparkContext.broadcast(GramSet([r.i for r in rows], [r.t for r in rows], window))
        done = out.mapInArrow(_scanner(grams, text_col), out.schema)
        if n > 1:
            done = written(done, f"block{k}")
            drop(out)
        out = done
    return out


def _scanner(grams, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grams.value
        for b in slices(batches, text_col):
            rows, hit, pairs = g.scan(filled(b, text_col))
            n_words = np.bincount(rows, minlength=b.num_rows)
            first = np.concatenate(([0], np.cumsum(n_words)))
            hits, items = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            for r in np.unique(rows[hit]).tolist():
                own = hit[first[r] : first[r + 1]].copy()
                for x in range(0, len(hits[r]), 2):
                    own[hits[r][x] : hits[r][x + 1]] = True
                hits[r] = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).tolist()
            for r, i in pairs.T.tolist():
                if g.names[i] not in items[r]:
                    items[r].append(g.names[i])
            new = [pa.array(x, f.type) for x, f in zip((n_words, hits, items), list(b.schema)[-3:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], *new], schema=b.schema)

    return run


def n_hit(hits: str = "_hits"):
    """Number of hit words, from the runs."""
    return F.expr(f"cast(aggregate(`{hits}`, 0L, (s, x) -> x - s) as long)")  # ... to - (from - sum): alternating signs, even length


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated`` of every document."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), "text"), bench, window)
    return found.select("doc_id", F.col("_n_words").alias("n_words"), n_hit().alias("n_hit"), F.col("_items").alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, most_hit: float = 0.0) -> DataFrame:
    """Documents of which no more than ``most_hit`` of the words are hit, with their columns."""
    found = scan(docs, bench, window)
    n_words, hits, _ = found.columns[-3:]
    return found.filter(n_hit(hits) <= F.lit(most_hit) * F.col(n_words)).select(docs.columns)


def cut_spans(text: str, hits: list[int]) -> str:
    """``text`` without its hit words and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    is_word = _word_table()[np.frombuffer(data, np.uint8)] != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for a, b in zip(hits[::2], hits[1::2], strict=True):
        kept.append(data[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def remove_spans(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, each without its hit spans; other columns stay."""
    found = scan(docs, bench, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            i = b.schema.get_field_index("text")
            hits = b.column(b.num_columns - 2)
            texts = [t if not h else cut_spans(t, h) for t, h in zip(b.column(i).to_pylist(), hits.to_pylist(), strict=True)]
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    return found.mapInArrow(run, found.schema).select(docs.columns)
