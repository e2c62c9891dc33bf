"""Language-model scoring of whole texts: a causal self-attention model over subwords, with counts of all words.

The score of a text is the sum over its words (lower-cased A-Z, between ASCII white space) and one end of
``log10(MIX * a + (1 - MIX) * c / N)``: a is the attention model's probability of the word (product over its subword
tokens, the last of which ends it) given all before in its window, c / N the word's share of all training tokens. Both
are distributions over all words, so the mixture is one.

The corpus is read once. Each task cuts its documents into blocks and writes, for each, the subwords of its distinct words,
their training counts, and the texts as word numbers; words are put together from their subwords again where needed. The words of all blocks meet by word
to be counted, and the counts of those that several blocks have go back to their blocks, which are then scored one by
one. A word has a row for each block at most; where it can have more than ``BLOCKS_A_WORD``, its rows are dealt out by
block too and counted in two steps. The model's classes and their neighbours are counted over all training texts. Its weights are
fitted on all windows of all training texts, each of which is met at least once. Where there are more than
``PART_WINDOWS``, a hash of row and place deals them to parts of about so many and, in each, to ``ROUNDS - 1`` rounds: the
parts learn side by side from common weights, which are averaged after each round. A round before them, of the windows of
one part, gives them a common start.

Cases: null and empty texts are the end alone. Rows with a null doc_id are scored and count as training rows. Repeated
rows stay rows and count each. Other columns are ignored, whatever their names. With no training rows the counts are
zero and the model alone scores. An empty table gives an empty result.
"""

import os
import pickle
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import drop, new_path, written
from .attention import CLASSES, END, RARE, STEPS, WINDOW, Classes, Subwords, fresh_state, joined, neighbours, sequence_logs, spellings, trained, trained_on, training_windows, windows
from .words import ascii_words, filled, gathered, give_back

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
FOLDS, HELD_OUT = 5, 1
WINDOW_SHARE, PART_WINDOWS, ROUNDS, SEED = 1, 192_000, 4, 3  # one window of how many is learnt from: all
BLOCK_BYTES, BLOCKS_A_WORD = 8 << 20, 1 << 14
SPELL_WORDS = 20_000  # so many distinct words are spelled at a time
SLICE_WORDS = 60_000  # so many words of a block are scored at a time, or one text
MIX = 0.8


class Model:
    """What scoring needs besides the counts; a few MB, sent to the executors once."""

    def __init__(self, ranks: bytes, texts: list[str], steps: int = STEPS):
        code = Subwords(ranks)
        tokens = [code.tokens(words_of(t))[0] for t in texts]
        self.ranks, self.classes = ranks, Classes(tokens, code.size)
        self.weights = trained([np.concatenate((self.classes.of[t], [END])) for t in tokens], self.classes.slot, steps)

    @classmethod
    def fitted(cls, ranks: bytes, classes: Classes, weights: dict[str, np.ndarray]) -> "Model":
        self = cls.__new__(cls)
        self.ranks, self.classes, self.weights = ranks, classes, weights
        return self

    def spelling(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spelled(*Subwords(self.ranks).tokens(words))

    def spelled(self, tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the tokens of all words and, after them, of the end; where each begins; what their rare tokens cost."""
        classes = np.concatenate((self.classes.of[tokens], [END]))
        return classes, np.concatenate((begin, [len(classes)])), np.where(classes == RARE, self.classes.log_rare, 0.0)

    def event_logs(self, spelling: tuple[np.ndarray, np.ndarray, np.ndarray], event: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """ln of the model's probability of events: numbers of words, and of the end, of texts that begin at ``firsts``."""
        classes, begin, rare = spelling
        n = np.diff(begin)[event]
        at = np.cumsum(n) - n
        flat = np.repeat(begin[event] - at, n) + np.arange(n.sum())
        logs = sequence_logs(self.weights, self.classes.slot, classes[flat], np.add.reduceat(n, firsts))
        return np.add.reduceat(logs + rare[flat], at)


def words_of(text: str) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").lower().split()]


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)), F.lit(-1))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, in which the planes of high bytes are nearly empty."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


BLOCKS = "kind int, block long, idx int, n long, spelled binary, sizes binary, own binary, numbers binary, doc_ids array<long>, lengths array<int>, held array<boolean>, seeds array<long>"


@lru_cache(maxsize=1)
def _subwords(ranks: bytes) -> Subwords:
    return Subwords(ranks)


def _blocks(docs: DataFrame, ranks: bytes, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of kind 1: a block's distinct words (subwords, and how many a word has), their training counts (``own``), its
    texts as word numbers.

    Of kind 2: how often a task's training texts have each token (idx); how many windows (idx -1) and words (-2) they have.
    """
    longs, flags = pa.list_(pa.int64()), pa.list_(pa.bool_())
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("idx", pa.int32()), ("n", pa.int64()), ("spelled", pa.binary()), ("sizes", pa.binary()), ("own", pa.binary()), ("numbers", pa.binary()), ("doc_ids", longs), ("lengths", pa.list_(pa.int32())), ("held", flags), ("seeds", longs)])
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

        code = _subwords(sent.value)
        in_all, n_windows, n_words = np.zeros(2 * code.size, np.int64), 0, 0
        for k, b in enumerate(gathered(batches, "text", block_bytes)):
            block = TaskContext.get().partitionId() << 32 | k
            words, rows = ascii_words(filled(b, "text"))
            coded = words.dictionary_encode()
            numbers = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(-np.bincount(numbers, minlength=len(coded.dictionary)), kind="stable")  # small numbers for common words
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            names, numbers = coded.dictionary.take(pa.array(order)), rank[numbers]
            held = b.column(b.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(numbers[~held[rows]], minlength=len(names))
            del words, coded
            spelled, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
            for at in range(0, len(names), SPELL_WORDS):
                tokens, begin = code.tokens(names.slice(at, SPELL_WORDS).to_pylist())
                spelled.append(tokens.astype(np.int32))
                sizes.append(np.diff(begin).astype(np.int32))
            tokens, sizes = np.concatenate(spelled), np.concatenate(sizes)
            in_all += np.bincount(tokens, np.repeat(counts, sizes), len(in_all)).astype(np.int64)
            n_tokens = np.bincount(rows, sizes[numbers], b.num_rows).astype(np.int64) + 1
            n_windows += len(windows(n_tokens[~held])[0])
            n_words += int(counts.sum())
            seeds = b.column(b.schema.get_field_index("seed")).to_pylist()
            yield out(1, kind=[1], block=[block], spelled=[packed(tokens)], sizes=[packed(sizes)], own=[packed(counts)], numbers=[packed(numbers)], doc_ids=[b.column(0).to_pylist()], lengths=[np.bincount(rows, minlength=b.num_rows).tolist()], held=[held.tolist()], seeds=[seeds])
        seen = np.flatnonzero(in_all)
        give_back()
        yield out(len(seen) + 2, kind=np.full(len(seen) + 2, 2, np.int32), idx=np.append(seen, [-1, -2]).astype(np.int32), n=np.append(in_all[seen], [n_windows, n_words]))

    path = new_path(docs.sparkSession, "blocks")
    seed = F.xxhash64(F.lit(SEED), "doc_id", "text").alias("seed")
    docs.select("doc_id", "text", "held_out", seed).mapInArrow(run, BLOCKS).write.partitionBy("kind").option("parquet.block.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.schema(BLOCKS).parquet(path)


def _words(blocks: DataFrame, ranks: bytes) -> DataFrame:
    """``block, idx, word, n``: the distinct words of all blocks, with their training counts."""
    sent = blocks.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("block", pa.int64()), ("idx", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = spellings(sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                tokens, sizes, own = unpacked(row["spelled"]), unpacked(row["sizes"]), unpacked(row["own"])
                ends = np.concatenate(([0], np.cumsum(sizes)))
                for at in range(0, len(sizes), SPELL_WORDS):
                    to = min(at + SPELL_WORDS, len(sizes))
                    word = joined(pieces, tokens[ends[at] : ends[to]], sizes[at:to])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(to - at, row["block"])), pa.array(np.arange(at, to, dtype=np.int32)), word, pa.array(own[at:to], pa.int64())], schema=schema)
        give_back()

    return blocks.filter("kind = 1").select("block", "spelled", "sizes", "own").mapInArrow(run, "block long, idx int, word string, n long")


def _events(numbers: np.ndarray, lengths: np.ndarray, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts, as many as make a slice: the first and the one after the last, their words and ends (``end``), where each begins.

    ``lengths`` has the words of each text and its end.
    """
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + SLICE_WORDS, side="right")))
        skipped = ends[at] - lengths[at] - at  # words of the texts before
        firsts = ends[at:to] - lengths[at:to] - (ends[at] - lengths[at])
        event = np.full(lengths[at:to].sum(), end, np.int64)
        event[np.delete(np.arange(len(event)), firsts + lengths[at:to] - 1)] = numbers[skipped : ends[to - 1] - to]
        yield at, to, event, firsts
        at = to


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of unsigned longs, mixed (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of_one_size(rows: np.ndarray) -> pa.Array:
    """The bytes of each row, without an object for each."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _joined(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column without nulls, one after the other; the opposite of ``_of_one_size``."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy()


LEARNT = "kind int, key long, data binary"


def _learnt(blocks: DataFrame, classes: Classes, wanted: float, kinds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Rows of kind 0: a task's counts of what follows a class (key); of kind 1: the windows drawn (key: their hash).

    They are made anew from the blocks whenever they are read, as all windows together would outweigh the texts.

    A window is drawn if its hash, of the row's seed and its number in the text, is under the share ``wanted``: texts of
    any length, and all places in them, have the same chance, however the rows are dealt out.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(classes)
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("data", pa.binary())])
    bound = min(2**64 - 1, int(wanted * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follows, of = np.zeros((CLASSES, CLASSES), np.int64), sent.value.of
        for batch in batches:
            for row in batch.to_pylist():
                tokens, sizes, numbers = unpacked(row["spelled"]), unpacked(row["sizes"]), unpacked(row["numbers"])
                classes, sizes = np.concatenate((of[tokens], [END])), np.concatenate((sizes, [1]))
                begin = np.cumsum(sizes) - sizes
                held, seeds = np.array(row["held"], bool), np.array(row["seeds"], np.int64).view(np.uint64)
                lengths = np.array(row["lengths"], np.int64) + 1
                learnt = ~held
                numbers = numbers[np.repeat(learnt, lengths - 1)]
                lengths, seeds = lengths[learnt], seeds[learnt]
                for at, to, event, firsts in _events(numbers, lengths, len(sizes) - 1):
                    n = sizes[event]
                    flat = classes[np.repeat(begin[event] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    if 0 in kinds:
                        follows += neighbours(flat)
                    if 1 not in kinds:
                        continue
                    own = np.add.reduceat(n, firsts)
                    ends = np.cumsum(own)
                    starts, text = windows(own)
                    first = (ends - own)[text]
                    place = (starts - first).astype(np.uint64)
                    h = _mixed(_mixed(seeds[at:to][text] + np.uint64(0x9E3779B97F4A7C15)) + place * np.uint64(0x9E3779B97F4A7C15))
                    drawn = np.flatnonzero(h <= np.uint64(bound))
                    if len(drawn):
                        rows = training_windows(flat, starts[drawn], ends[text[drawn]], first[drawn])
                        m = len(drawn)
                        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(_mixed(h[drawn]).view(np.int64)), _of_one_size(rows)], schema=schema)
        some = np.flatnonzero(follows.any(1))
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(some), np.int32)), pa.array(some), pa.array([packed64(follows[c]) for c in some], pa.binary())], schema=schema)

    rows = blocks.filter("kind = 1").select("spelled", "sizes", "numbers", "lengths", "held", "seeds")
    return rows.mapInArrow(run, LEARNT).filter(F.col("kind").isin(*kinds))


def _weights(drawn: DataFrame, n: int, slot: np.ndarray, steps: int) -> dict[str, np.ndarray]:
    """Weights after ``steps`` steps, or as many as meet all windows ``drawn`` (key, data), which are about ``n``.

    One part learns at first, then all from its state; their states are averaged at the end of each round.
    """
    parts = max(1, -(-n // PART_WINDOWS))
    if parts == 1:
        return _round(drawn.withColumn("part", F.lit(0)), 1, slot, fresh_state(), 0, steps, steps)[0]
    edges = [steps * r // ROUNDS for r in range(ROUNDS + 1)]
    place = F.pmod("key", F.lit(parts * (ROUNDS - 1)))
    start = drawn.filter(F.pmod("key", F.lit(parts * ROUNDS)) == 0).withColumn("part", F.lit(0))
    state = _round(start, 1, slot, fresh_state(), 0, edges[1], steps)
    for r in range(1, ROUNDS):
        own = drawn.filter(F.floor(place / parts) == r - 1).withColumn("part", F.pmod(place, F.lit(parts)).cast("int"))
        state = _round(own, parts, slot, state, edges[r], edges[r + 1], steps)
    return state[0]


State = tuple[dict[str, np.ndarray], ...]


def _round(rows: DataFrame, parts: int, slot: np.ndarray, state: State, since: int, to: int, steps: int) -> State:
    """The mean state, by windows, of the parts of ``rows`` (part, key, data), each of which learns from all its windows."""
    sent = rows.sparkSession.sparkContext.broadcast((state, slot))
    schema = "n long, state binary"

    def row(n: int, state: State) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([cloudpickle.dumps(state)], pa.binary())], ["n", "state"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, data = [np.empty(0, np.int64)], []
        for b in batches:
            if b.num_rows:
                keys.append(b.column(0).to_numpy())
                data.append(_joined(b.column(1)))
        if data:
            windows, key = np.concatenate(data).view("<i2").reshape(-1, WINDOW + 1), np.concatenate(keys)
            data.clear()
            order = np.lexsort((windows[:, 1], windows[:, 2], key))  # the same order however the rows came
            state, slot = sent.value
            yield row(len(key), trained_on(windows[order], slot, state, since, to, steps))
            give_back()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, state = _mean((n.as_py(), pickle.loads(x.as_py())) for b in batches for n, x in zip(*b.columns, strict=True))
        if n:
            yield row(n, state)

    one_each = rows.repartitionById(parts, "part") if parts > 1 else rows.repartition(1)
    made = written(one_each.select("key", "data").mapInArrow(learn, schema), "weights")
    n, got = _mean((r.n, pickle.loads(r.state)) for r in made.coalesce(8).mapInArrow(mean, schema).collect())
    drop(made)
    return got if n else state


def _mean(states: Iterable[tuple[int, State]]) -> tuple[int, State]:
    """How many windows these states have met together, and their mean."""
    total, sums = 0, ()
    for n, state in states:
        total += n
        sums = sums or tuple({k: np.zeros(w.shape) for k, w in x.items()} for x in state)
        for x, y in zip(sums, state, strict=True):
            for k in x:
                x[k] += n * y[k].astype(np.float64)
    return total, tuple({k: (w / total).astype(np.float32) for k, w in x.items()} for x in sums)


def packed64(numbers: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked64(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _summed(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.zeros(CLASSES, np.int64)
    for data in rows.column("data"):
        total += unpacked64(data.as_py())
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([packed64(total)], pa.binary())], names=["key", "data"])


def fit(docs: DataFrame, ranks: bytes, steps: int = STEPS) -> Model:
    """The model of the training rows of ``docs`` (doc_id, text, held_out)."""
    return _fit(_blocks(docs, ranks), ranks, steps)


def _fit(blocks: DataFrame, ranks: bytes, steps: int) -> Model:
    counts = written(blocks.filter("kind = 2").groupBy("idx").agg(F.sum("n").alias("n")), "tokens")
    n_windows = counts.filter("idx = -1").agg(F.sum("n")).first()[0] or 0
    if not n_windows:
        return Model(ranks, [], steps)
    common = [r.idx for r in counts.filter("idx >= 0").orderBy(F.desc("n"), "idx").limit(CLASSES - 2).collect()]
    classes = Classes.counted(common, _subwords(ranks).size)
    wanted = min(n_windows, max(PART_WINDOWS, n_windows // WINDOW_SHARE))
    follows = np.zeros((CLASSES, CLASSES), np.int64)
    for row in _learnt(blocks, classes, 1.0, (0,)).select("key", "data").groupBy("key").applyInArrow(_summed, "key long, data binary").collect():
        follows[row.key] = unpacked64(row.data)
    classes.arrange(follows)
    weights = _weights(_learnt(blocks, classes, wanted / n_windows, (1,)).select("key", "data"), wanted, classes.slot, steps)
    return Model.fitted(ranks, classes, weights)


def _counted(pairs: DataFrame, n_blocks: int) -> DataFrame:
    """``of`` (block), ``idx``, ``c``: twice a word's training count, plus 1 in the first of its blocks if it has any.

    Of words that several blocks have. Each row is shuffled once, by word, or by word and share of the blocks.
    """
    sums = {"c": F.sum("n"), "first": F.min("block"), "blocks": F.count("*")}
    shares = -(-n_blocks // BLOCKS_A_WORD)
    if shares <= 1:
        of_word = Window.partitionBy("word")
        got = pairs.select("block", "idx", *[x.over(of_word).alias(n) for n, x in sums.items()])
    else:
        dealt = pairs.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares))).repartition("word", "share")
        part = dealt.groupBy("word", "share").agg(*[x.alias(n) for n, x in sums.items()])
        whole = part.groupBy("word").agg(F.sum("c").alias("c"), F.min("first").alias("first"), F.sum("blocks").alias("blocks"))
        got = dealt.drop("n").join(part.select("word", "share").join(whole, "word"), ["word", "share"])
    first = (F.col("block") == F.col("first")) & (F.col("c") > 0)
    return got.filter("blocks > 1").select(F.col("block").alias("of"), "idx", (F.col("c") * 2 + first.cast("long")).alias("c"))


def scores(docs: DataFrame, model: Model, block_bytes: int = BLOCK_BYTES, mix: float = MIX) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs`` (doc_id, text, held_out)."""
    return _scores(docs, _blocks(docs, model.ranks, block_bytes), model, mix)


def _scores(docs: DataFrame, blocks: DataFrame, model: Model, mix: float = MIX) -> DataFrame:
    spark = docs.sparkSession
    n_ends = docs.filter("not held_out").count()
    total = (blocks.filter("idx = -2").agg(F.sum("n")).first()[0] or 0) + n_ends
    sent = spark.sparkContext.broadcast((model, n_ends, total))
    pairs = _words(blocks, model.ranks)
    counted = _counted(pairs, blocks.filter("kind = 1").count())
    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("kinds", pa.int64())])

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        model, n_ends, total = sent.value
        parts = []
        for row in texts.to_pylist():
            sizes, numbers, lengths = unpacked(row["sizes"]), unpacked(row["numbers"]), np.array(row["lengths"], np.int64) + 1
            c = np.append(unpacked(row["own"]).astype(np.int64), n_ends)  # of words that no other block has
            got, idx = counts.column("c").to_numpy(), counts.column("idx").to_numpy()
            fresh = c[:-1] > 0  # words to be counted as kinds here
            fresh[idx] = got & 1
            c[idx] = got >> 1
            with np.errstate(divide="ignore"):
                seen = np.log((1 - mix) * c / max(1, total))
            halves, own, spelling = np.log10(c + 0.5), np.log(mix) if total else 0.0, model.spelled(unpacked(row["spelled"]), np.concatenate(([0], np.cumsum(sizes))))
            sums = np.zeros((3, len(lengths)))
            for at, to, event, firsts in _events(numbers, lengths, len(sizes)):
                logs = np.logaddexp(model.event_logs(spelling, event, firsts) + own, seen[event]) / np.log(10)
                sums[:, at:to] = [np.add.reduceat(x, firsts) for x in (c[event] > 0, halves[event], logs)]
            kinds = np.zeros(len(lengths), np.int64)
            kinds[:1] = fresh.sum()
            parts.append(pa.table([row["doc_ids"], row["held"], lengths, sums[0].astype(np.int64), sums[1], sums[2], kinds], schema=result))
        give_back()
        return pa.concat_tables(parts) if parts else result.empty_table()

    payload = blocks.filter("kind = 1").select("block", "spelled", "sizes", "own", "numbers", "doc_ids", "lengths", "held")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, kinds long"
    done = written(payload.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(run, schema), "scored")
    kinds = (done.agg(F.sum("kinds")).first()[0] or 0) + (n_ends > 0)
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (kinds + 1))))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def score_all(docs: DataFrame, tokenizers: str | None = None, vocabulary: str = VOCABULARY, steps: int = STEPS) -> DataFrame:
    """Learns from the rows that are not held out and scores all. ``tokenizers``: the folder of vocabulary files, on the
    driver; if not given, that of the session's ``vellumine.tokenizers``, or ``TOKENIZERS``."""
    tokenizers = tokenizers or docs.sparkSession.conf.get("vellumine.tokenizers", TOKENIZERS)
    with open(os.path.join(tokenizers, vocabulary), "rb") as file:  # the driver's copy; executors get it with the model
        ranks = file.read()
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"))
    blocks = _blocks(marked, ranks)
    return _scores(marked, blocks, _fit(blocks, ranks, steps))
