"""Quality classifier: histogram gradient-boosted trees over document statistics.

Learning: a bounded sample of labelled rows (``MOST_LABELLED``, the smallest by hash; documented bound) has its
statistics collected, binned by quantiles and boosted with logistic loss. The trees are flattened into arrays, which
score all rows of a batch level by level. Statistics are counted over whole texts.

Cases: null and empty texts have statistics zero and get a score. Without labels of both kinds all scores are the share
of label 1 (0.5 without labels). Several labels of one document are averaged, null labels are ignored. Rows with a
null doc_id are scored and are not held out. Repeated rows stay rows; other columns, whatever their names, are kept by
``accepted``. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import ascii_words, byte_offsets, filled, fresh, slices

MOST_LABELLED, SEED = 20_000, 11
TREES, DEPTH, RATE, BINS, RIDGE, LEAST_ROWS = 80, 4, 0.2, 64, 1.0, 10
CUT, FOLDS = 0.3, 5
CHUNK = 1 << 18  # bytes counted at a time

# Classes of bytes whose shares are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\x0b\x0c\r",
    "line": b"\n",
    "stop": b".,;:'\"-?()",
    "bang": b"!",
    "bar": b"|",
    "sign": b"#$%&*@^~+=<>_/\\{}[]`",
    "high": bytes(range(0x80, 0x100)),
}
STATISTICS = [*CLASSES, "log_words", "word_bytes", "distinct_words", "top_word", "word_repeats", "signed_words", "capital_words", "line_words", "distinct_lines", "long_words"]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text without nulls."""
    n, at = len(texts), byte_offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    kind = np.zeros(256, np.int64)
    for k, own in enumerate(CLASSES.values(), 1):
        kind[list(own)] = k
    counts = np.zeros(n * 11, np.int64)
    for a in range(0, len(data), CHUNK):
        own = np.searchsorted(at - at[0], np.arange(a, min(a + CHUNK, len(data))), side="right") - 1
        counts += np.bincount(own * 11 + kind[data[a : a + CHUNK]], minlength=n * 11)
    counts = counts.reshape(n, 11)[:, 1:]
    shares = counts / np.maximum(1, np.diff(at))[:, None]

    words, rows = ascii_words(texts, lower=False)
    n_words = np.bincount(rows, minlength=n)
    each = np.maximum(1, n_words)
    codes = pc.index_in(words, value_set=words.unique()).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
    pair, times = np.unique(rows * (len(words) + 1) + codes, return_counts=True)
    of = pair // (len(words) + 1)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, times)
    again = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
    first = pc.binary_slice(words.cast(pa.binary()), 0, 1)
    last = pc.binary_slice(words.cast(pa.binary()), -1)

    def by_row(flags: np.ndarray, owners: np.ndarray = rows) -> np.ndarray:
        return np.bincount(owners[flags], minlength=n)

    def in_class(ends: pa.Array, *names: str) -> np.ndarray:
        bytes_ = pa.array([bytes([x]) for k in names for x in CLASSES[k]], pa.binary())
        return pc.is_in(ends, value_set=bytes_).to_numpy(zero_copy_only=False)

    lists = pc.split_pattern(texts, "\n")
    lines, line_rows = lists.flatten(), np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    line_codes = pc.index_in(lines, value_set=lines.unique()).to_numpy(zero_copy_only=False).astype(np.int64)
    n_lines = np.maximum(1, np.bincount(line_rows, minlength=n))
    distinct_lines = np.bincount(np.unique(line_rows * (len(lines) + 1) + line_codes) // (len(lines) + 1), minlength=n)
    more = [
        np.log1p(n_words), np.bincount(rows, weights=lengths, minlength=n) / each, np.bincount(of, minlength=n) / each, top / each,
        by_row(again, rows[1:]) / each, by_row(in_class(last, "bang", "bar", "sign")) / each, by_row(in_class(first, "upper")) / each,
        n_words / n_lines, distinct_lines / n_lines, by_row(lengths > 25) / each,
    ]
    return np.column_stack([shares, *more])


class Trees:
    """Boosted trees of one depth as arrays: node k of a tree has children 2k + 1 and 2k + 2; the last level has values."""

    def __init__(self, base: float, features: np.ndarray, cuts: np.ndarray, values: np.ndarray):
        self.base, self.features, self.cuts, self.values = base, features, cuts, values

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for features, cuts, values in zip(self.features, self.cuts, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range((len(features) + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
            total += values[node - len(features)]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def boosted(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Trees fitted by second-order boosting on histograms of quantile bins."""
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if len(np.unique(y)) < 2:
        return Trees(float(np.clip(base, -5, 5)), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])  # bin <= b: x <= edge b
    offset, raw, n_f = np.arange(x.shape[1]) * bins, np.full(len(y), base), x.shape[1]
    out = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        features, cuts, values = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((node - first) * (n_f * bins))[:, None] + offset + binned
            flat = slot.ravel()
            size = width * n_f * bins
            sums = [np.bincount(flat, weights=np.repeat(w, n_f), minlength=size).reshape(width, n_f, bins) for w in (g, h, np.ones(len(y)))]
            (gl, hl, nl) = (np.cumsum(s, axis=2) for s in sums)
            gt, ht, nt = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = 0
            for k in range(width):
                f, b = divmod(int(gain[k].argmax()), bins)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    features[first + k], cuts[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), features[node]] > cuts[node])
        leaf = node - inner
        values = -rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + RIDGE)
        raw += values[leaf]
        for kept, new in zip(out, (features, cuts, values), strict=True):
            kept.append(new)
    return Trees(base, *map(np.array, out))


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)), F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Trees:
    """Learns from at most ``most`` labelled documents outside fold 0; of rows that share a doc_id, from one."""
    marks = labels.filter("quality is not null and doc_id is not null").filter(fold(F.col("doc_id")) != 0)
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("i")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    marks = marks.orderBy(F.xxhash64(F.lit(SEED), "i")).limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = statistics(filled(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "h", "y", "x"])

    # 16 bytes each of ``most`` rows at most are broadcast.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), F.col("doc_id") == F.col("i")).select("doc_id", F.xxhash64("text").alias("h"), "y", "text")
    found = own.mapInArrow(run, "doc_id long, h long, y double, x array<double>")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("h", "y", "x")).alias("r")).select("r.y", "r.x").toPandas()
    if not len(rows):
        return boosted(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x, y = np.array(rows["x"].tolist()), rows["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # the order of rows doesn't matter then
    return boosted(x[order], y[order])


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """All rows and columns of ``docs``, and last the score."""
    name = fresh(docs.columns, "_score")[0]
    out = docs.withColumn(name, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            i = b.num_columns - 1
            yield b.set_column(i, b.schema.field(i), pa.array(model.score(statistics(filled(b, "text"))), pa.float64()))

    return out.mapInArrow(run, out.schema)


def accepted(docs: DataFrame, labels: DataFrame, cut: float = CUT, most: int = MOST_LABELLED) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns."""
    found = scored(docs, fit(docs, labels, most))
    return found.filter(F.col(found.columns[-1]) >= cut).select(docs.columns)


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels, most))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))
