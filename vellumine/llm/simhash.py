"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison.

``near_duplicates`` has fingerprints of 64 bits and links all within a radius, without exception. ``similar`` and
``keep_one`` link texts whose sets of five-word shingles have a likeness (shared of all) of 0.8 or more, as estimated
from fingerprints of ``WIDE`` bits: their radius is the distance expected at that likeness and one standard deviation.
Texts meet there in buckets of min-hashes (``BANDS`` of ``ROWS``, of which a pair at 0.8 shares one in 99.8 % of cases).

Cases: a null or empty text, and one without words, has fingerprint zero and is linked like any other. Rows with a
null ``doc_id`` get a fingerprint and the component of the documents that share it (null if none has an id); they
are no nodes of their own. Repeated rows stay rows. Other columns are ignored, whatever their names. An empty table
gives an empty result.
"""

from collections.abc import Iterator
from itertools import combinations
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .components import components
from .words import filled, give_back, slices

SHINGLE, RADIUS, SEED, BITS = 4, 4, 42, 64
STAGE_SHINGLE, LIKENESS, WIDE = 5, 0.8, 512
BANDS, ROWS = 16, 5
CHUNK = 1 << 15  # shingles whose bits are counted at a time
SMALL, BUCKET = 16, 8192  # larger buckets are compared as blocks of planes; still larger ones are split


def shingles(text: str, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, repeats included, ``CHUNK`` at a time; of the whole sequence where words are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    n, digest = len(last), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(at + CHUNK, n)].tolist(), last[at : at + CHUNK].tolist(), strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in pairs], "<u8")


def bits_set(words: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of 64-bit words."""
    return np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the hashes of all shingles, repeats included."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for h in shingles(text, shingle, seed):
        n, ones = n + len(h), ones + bits_set(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A hash of each of ``h`` (rows) for each of ``more`` (columns), by splitmix64."""
    x = h[:, None] + more[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(SEED)
_WORDS = _RNG.integers(0, 2**64, WIDE // 64, dtype=np.uint64)
_TIMES = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MORE = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def sketch(text: str, shingle: int = STAGE_SHINGLE, seed: int = SEED) -> tuple[bytes, np.ndarray]:
    """``WIDE`` bits of the set of shingles, and its ``BANDS`` bucket keys (signed longs)."""
    parts = list(shingles(text, shingle, seed))
    hashes = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
    ones, least = np.zeros(WIDE, np.int64), np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096]
        ones += bits_set(_mixed(h, _WORDS))
        least = np.minimum(least, (h[:, None] * _TIMES + _MORE).min(0))
    keys = (least * _TIMES[::-1]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), keys.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle, seed) for t in filled(b, "text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- comparison of many fingerprints (rows of 64-bit words): planes[p] holds bit p of 64 fingerprints a word


def planes_of(fps: np.ndarray) -> np.ndarray:
    """bits x ceil(n/64) words; bit j of word w of plane p is bit p of fingerprint 64 w + j."""
    fps = np.ascontiguousarray(fps, "<u8").reshape(len(fps), -1)
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
    lanes = np.zeros((bits.shape[1], -(-len(fps) // 64) * 64), np.uint8)
    lanes[:, : len(fps)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


def _added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry and sum of three bits in every lane."""
    half = a ^ b
    return (a & b) | (half & c), half ^ c


def _above(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count (lowest bits first), or its overflow, exceeds the radius."""
    over, even = over.copy(), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            even = even & counters[k]
        else:
            over |= even & counters[k]
            even = even & ~counters[k]
    return over


def within(planes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query index, lane) at distance ``radius`` or less.

    Differences are counted for 64 lanes a word with carry-save adders, eight planes at a time. Blocks of 64 lanes are
    abandoned once all their lanes exceed the radius for every query.
    """
    queries = np.ascontiguousarray(queries, "<u8").reshape(len(queries), -1)
    flips = np.zeros((), np.uint64) - np.unpackbits(queries.view(np.uint8), axis=1, bitorder="little").T.astype(np.uint64)
    alive = np.arange(planes.shape[1])
    ones = twos = fours = over = np.zeros((len(queries), len(alive)), np.uint64)
    high = [over] * max(0, radius.bit_length() - 3)
    step = max(8, len(planes) // 64 * 8)
    for p in range(0, len(planes), 8):
        d = [planes[k][alive][None, :] ^ flips[k][:, None] for k in range(p, p + 8)]
        two, ones = _added(ones, d[0], d[1])
        more, ones = _added(ones, d[2], d[3])
        four, twos = _added(twos, two, more)
        two, ones = _added(ones, d[4], d[5])
        more, ones = _added(ones, d[6], d[7])
        eight, twos = _added(twos, two, more)
        carry, fours = _added(fours, four, eight)
        for k, h in enumerate(high):
            high[k], carry = h ^ carry, h & carry
        over = over | carry
        if (p + 8) % step == 0 and p + 8 < len(planes):
            live = ~(_above([ones, twos, fours, *high], over, radius) == ~np.uint64(0)).all(axis=0)
            if not live.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if live.sum() * 4 < len(live) * 3:
                alive, ones, twos, fours, over = alive[live], ones[:, live], twos[:, live], fours[:, live], over[:, live]
                high = [h[:, live] for h in high]
    near = ~_above([ones, twos, fours, *high], over, radius)
    q, lane = np.nonzero(np.unpackbits(np.ascontiguousarray(near).view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little"))
    return q, alive[lane // 64] * 64 + lane % 64


class _Forest:
    """Disjoint sets of one bucket: a link within a set is dropped, so that m rows give fewer than m links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def bucket_links(fps: np.ndarray, radius: int = RADIUS, queries: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the fingerprints of one large bucket.

    Rows are compared with all others, ``queries`` at a time. Rows that have joined the set which is largest after the
    first comparison need not be: they are linked with one another, and the rest are compared with them.
    """
    n, planes, label, out, largest = len(fps), planes_of(fps), np.arange(len(fps)), ([], []), None
    waiting, asked = np.arange(n), np.zeros(planes.shape[1] * 64, bool)
    asked[n:] = True
    while len(waiting):
        own, waiting = waiting[:queries], waiting[queries:]
        words = np.flatnonzero(~asked.reshape(-1, 64).all(1))  # rows that have been compared with all are passed over
        q, lane = within(planes[:, words], fps[own], radius)
        q, lane = own[q], words[lane // 64] * 64 + lane % 64
        asked[own] = True
        q, lane = q[lane < n], lane[lane < n]
        while len(q):
            q, lane = q[label[q] != label[lane]], lane[label[q] != label[lane]]
            if not len(q):
                break
            first = np.unique(np.maximum(label[q], label[lane]), return_index=True)[1]  # each set is hooked to one smaller
            hook = np.arange(n)
            a, b = label[q[first]], label[lane[first]]
            hook[np.maximum(a, b)] = np.minimum(a, b)
            out[0].append(q[first])
            out[1].append(lane[first])
            while ((up := hook[hook]) != hook).any():
                hook = up
            label = hook[label]
        if largest is None:
            largest = int(np.flatnonzero(label == np.bincount(label).argmax())[0])
        waiting = waiting[label[waiting] != label[largest]]
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def group_links(starts: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups that begin at ``starts`` (the last start is the number of rows)."""
    sizes, fps = np.diff(starts), fps.reshape(len(fps), -1)
    out_a, out_b = [], []
    chunk = (1 << 16) // fps.shape[1]
    small = (sizes > 1) & (sizes <= SMALL)
    if small.any():
        left = np.repeat(np.where(small, starts[1:], 0), sizes)  # end of each row's group if it is a small one
        rows, forest = np.arange(len(fps)), _Forest(len(fps))
        for step in range(1, int(sizes[small].max())):
            a = rows[rows + step < left]
            for at in range(0, len(a), chunk):
                part = a[at : at + chunk]
                _, lane = within(planes_of(fps[part] ^ fps[part + step]), np.zeros((1, fps.shape[1]), np.uint64), radius)
                for x in part[lane[lane < len(part)]].tolist():
                    if forest.add(x, x + step):
                        out_a.append(x)
                        out_b.append(x + step)
    for g in np.flatnonzero(sizes > SMALL):
        a, b = bucket_links(fps[starts[g] : starts[g + 1]], radius)
        out_a += (a + starts[g]).tolist()
        out_b += (b + starts[g]).tolist()
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def _blocks(radius: int, n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` blocks of bits: a pair within the radius agrees in n - radius of them."""
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def bucket_keys(radius: int, rows: int) -> list[Column]:
    """A key for each choice of blocks that a pair within the radius can agree in.

    The more rows, the more and the longer the keys: so many bits that a bucket of unlike rows has some 16 (up to some
    10^11 rows, with 70 keys a row; beyond, buckets grow).
    """
    n = radius + 2
    while 2 ** (BITS * (n - radius) // n) * 16 < rows and n < radius + 4:
        n += 1
    parts = _blocks(radius, n)
    keys = []
    for t, chosen in enumerate(combinations(parts, n - radius)):
        key = F.lit(t).cast("long")
        for shift, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return keys


def links(reps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, rows: int | None = None) -> DataFrame:
    """``u, v``: links that join all of ``reps`` (distinct long fp, long rep; ``rows`` of them) within ``radius`` bits. Exact."""
    keys = bucket_keys(radius, reps.count() if rows is None else rows)
    return met(reps.select("fp", "rep", F.explode(F.array(*keys)).alias("k")), radius, bucket)


def _words(fps: pa.Array) -> np.ndarray:
    """Fingerprints (longs, or binaries of one length) as rows of 64-bit words."""
    if pa.types.is_integer(fps.type):
        return fps.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(fps.to_pylist()), "<u8").reshape(len(fps), -1)


def met(rows: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """``u, v``: links that join all of ``rows`` (k, fp, rep) that share a bucket ``k`` and are within ``radius`` bits.

    A bucket of over ``bucket`` rows is dealt out as pairs of its halves' blocks, so no task holds it whole and no pair
    goes uncompared.
    """
    hot = written(rows.groupBy("k").count().filter(F.col("count") > bucket).select("k", F.ceil(F.col("count") / (bucket // 2)).cast("long").alias("nb")), "hot")
    none = F.lit(0).cast("long")
    if hot.isEmpty():
        dealt = rows.select("k", none.alias("b"), none.alias("c"), "fp", "rep")
    else:
        own = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("nb"))
        other = F.explode(F.expr("sequence(0L, nb - 1)"))
        split = rows.join(hot, "k").withColumn("own", own).select("k", "own", "fp", "rep", other.alias("o")).filter("own <> o")
        dealt = rows.join(hot, "k", "left_anti").select("k", none.alias("b"), none.alias("c"), "fp", "rep").union(split.select("k", F.least("own", "o").alias("b"), F.greatest("own", "o").alias("c"), "fp", "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def found(cols: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
            a, b = group_links(starts, cols[3], radius)
            return pa.RecordBatch.from_arrays([pa.array(cols[4][a]), pa.array(cols[4][b])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [_words(c) if k == 3 else c.to_numpy(zero_copy_only=False) for k, c in enumerate(batch.columns)]
            held = new if held is None else [np.concatenate((h, x)) for h, x in zip(held, new, strict=True)]
            new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])) + 1
            if len(new):  # the last group may go on in the next batch
                yield found([h[: new[-1]] for h in held], np.concatenate(([0], new)))
                held = [h[new[-1] :] for h in held]
        if held is not None:
            yield found(held, np.array([0, len(held[0])]))
        give_back()

    return dealt.repartition("k", "b", "c").sortWithinPartitions("k", "b", "c", "fp").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """``doc_id, fp, component_id``: one row for each row of ``docs``; component_id is the smallest doc_id reachable.

    Equal fingerprints are collapsed first, so a group of copies of any size is one node.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle, seed), "fps")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    return _joined(fps, reps, links(reps.filter("rep is not null"), radius))


def _joined(fps: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    comps = components(found)
    of_fp = reps.join(comps, reps.rep == comps.node, "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def radius_of(likeness: float, bits: int = WIDE) -> int:
    """Differing bits expected of sets of one size with this share in common, and one standard deviation."""
    share = acos(2 * likeness / (1 + likeness)) / pi
    return int(bits * share + sqrt(bits * share * (1 - share)))


def similar(docs: DataFrame, shingle: int = STAGE_SHINGLE, likeness: float = LIKENESS, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fp, component_id`` like ``near_duplicates``, of documents linked by likeness of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps, keys = zip(*(sketch(t, shingle) for t in filled(b, "text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["doc_id", "fp", "keys"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, fp binary, keys array<long>")
    made = written(made, "sketches")
    reps = written(made.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("keys").alias("keys")), "reps")
    rows = reps.filter("rep is not null").select("fp", "rep", F.explode("keys").alias("k"))
    return _joined(made.select("doc_id", "fp"), reps.select("fp", "rep"), met(rows, radius_of(likeness), bucket))


def keep_one(docs: DataFrame, shingle: int = STAGE_SHINGLE, likeness: float = LIKENESS) -> DataFrame:
    """One document of each group of ``similar`` ones, with all its columns: the one with the smallest doc_id.

    Rows that share a doc_id count as one document; of them the row with the smallest text stays. A row without doc_id
    stays where no document with an id is of its group, one row for each such fingerprint.
    """
    found = written(similar(docs, shingle, likeness), "found")
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    out = docs.join(kept, "doc_id", "left_semi")
    twice = written(found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "twice")
    if not twice.isEmpty():
        rest = [c for c in docs.columns if c != "doc_id"]
        one = out.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.col("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])).alias("r"))
        one = one.select("doc_id", *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(rest)]).select(docs.columns)
        out = out.join(twice, "doc_id", "left_anti").unionByName(one)
    lone = found.filter("doc_id is null and component_id is null").select("fp").distinct()
    if not lone.isEmpty():
        out = out.unionByName(docs.filter("doc_id is null").dropDuplicates(["text"]))
    return out
