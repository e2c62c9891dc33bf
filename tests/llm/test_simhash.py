"""Wide fingerprints, longer keys, large buckets, and likeness of five-word shingles, against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.llm import components, simhash

from .test_cases import DOC, LONG, sentence


def grams(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a: str, b: str) -> float:
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def changed(text: str, n: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    words = text.split()
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"new{rng.integers(10**6)}"
    return " ".join(words)


def labels_of(pairs, n: int) -> list[int]:
    label = list(range(n))
    for a, b in pairs:
        if label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize(("words", "radius"), [(1, 0), (1, 4), (1, 7), (1, 8), (1, 20), (8, 86), (8, 255), (2, 40)])
def test_within_of_any_radius_and_width(words, radius):
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 2**63, words, dtype=np.uint64)
    flips = np.packbits(rng.random((333, 64 * words)) < rng.random((333, 1)) * 0.5, axis=1).view(np.uint64)
    fps = centre ^ flips
    want = np.bitwise_count(fps[:70, None, :] ^ fps[None, :, :]).sum(2) <= radius
    q, lane = simhash.within(simhash.planes_of(fps), fps[:70], radius)
    assert {(a, b) for a, b in zip(q.tolist(), lane.tolist(), strict=True) if b < 333} == set(zip(*(x.tolist() for x in np.nonzero(want)), strict=True))


@pytest.mark.parametrize("groups", [1, 2, 30, 700])
def test_forest_of_a_large_bucket(groups):
    rng = np.random.default_rng(groups)
    centres = rng.integers(0, 2**63, groups, dtype=np.uint64)
    fps = centres[rng.integers(0, groups, 1500)] ^ np.packbits(rng.random((1500, 64)) < 0.03, axis=1).view(np.uint64)[:, 0]
    a, b = simhash.bucket_links(fps, 4)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = labels_of(((int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)), 1500) if groups > 2 else None
    got = labels_of(zip(a.tolist(), b.tolist(), strict=True), 1500)
    assert near[a, b].all() and len(a) < 1500
    if want is None:  # checked by reachability: fewer steps than all pairs
        want, left = [None] * 1500, set(range(1500))
        while left:
            start = min(left)
            reached, new = {start}, {start}
            while new:
                new = {int(j) for i in new for j in np.flatnonzero(near[i])} - reached
                reached |= new
            for k in reached:
                want[k] = start
            left -= reached
    assert got == want


@pytest.mark.parametrize("rows", [10, 10**8, 10**10, 10**12])
def test_keys_of_any_length_lose_no_pair(spark, rows):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 60, dtype=np.uint64)
    b = a.copy()
    for k in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)
    df = spark.createDataFrame([(int(x.view(np.int64)), int(y.view(np.int64))) for x, y in zip(a, b, strict=True)], "fp long, other long")
    n = len(simhash.bucket_keys(4, rows))
    both = df.select(F.array(*simhash.bucket_keys(4, rows)).alias("k"), F.col("other").alias("fp")).select("k", F.array(*simhash.bucket_keys(4, rows)).alias("l"))
    assert both.filter(F.arrays_overlap("k", "l")).count() == 60 and n == {10: 15, 10**8: 35, 10**10: 70, 10**12: 70}[rows]
    assert both.filter(F.size(F.array_distinct("k")) == n).count() == 60


def test_likeness_against_brute_force(spark):
    texts = [sentence(k, 150) for k in range(25)]
    texts += [changed(texts[k], n, 100 * k + n) for k in range(25) for n in (0, 1, 2, 3, 12, 30)] + [None, "", "a b c", "A  b C", "a b d", LONG, LONG + " more"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC).repartition(4)
    for bucket in (8, 8192):
        comp = {r.doc_id: r.component_id for r in simhash.similar(docs, bucket=bucket).collect()}
        alike = [(i, j, likeness(texts[i] or "", texts[j] or "")) for i, j in itertools.combinations(range(len(texts)), 2) if (texts[i] or "") and (texts[j] or "")]
        sure, never = [(i, j) for i, j, x in alike if x >= 0.8], [(i, j) for i, j, x in alike if x < 0.6]
        assert len(sure) > 100 and np.mean([comp[i] == comp[j] for i, j in sure]) >= 0.97
        reach = labels_of([(i, j) for i, j, x in alike if x >= 0.6], len(texts))
        assert all(comp[i] != comp[j] for i, j in never if reach[i] != reach[j])
        assert comp[175] == comp[176] == 175 and comp[177] == comp[178] == 177 != comp[179] and comp[180] == comp[181] == 180
        kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
        assert kept == {i for i, c in comp.items() if i == c} or bucket == 8


def test_a_hot_group_of_near_copies_is_linked_in_blocks(spark):
    base = sentence(1, 200)
    docs = spark.createDataFrame([(i, changed(base, 2, i), "en", "s", 0) for i in range(400)] + [(1000, sentence(9, 200), "en", "s", 0)], DOC)
    got = {r.component_id for r in simhash.similar(docs, bucket=64).collect()}
    assert got == {0, 1000}


def test_links_of_equal_stars(spark):
    got = dict(components.components(spark.createDataFrame([(0, k) for k in range(1, 500)], "u long, v long")).collect())
    assert got == {k: 0 for k in range(1, 500)}
