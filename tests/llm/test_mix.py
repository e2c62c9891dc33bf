"""Mixing against a plain fair queue, and groups of equal rows of any size."""

import pytest
from pyspark.sql import functions as F

from vellumine.llm import mix

from .test_cases import DOC, brute_targets, sentence


def brute_queue(rows: list[tuple]) -> dict:
    """Words taken of each (source, h, doc_id): rows of a source in order of h, again and again, by finish time, up to the budget."""
    sizes = {}
    for source, _, _, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    goals, items = brute_targets(sizes), []
    for source in sizes:
        upto = 0
        for again in range(2):
            for s, h, i, size in sorted((r for r in rows if r[0] == source), key=lambda r: (r[1], r[2])):
                upto += size
                if size and goals[source]:
                    items.append((upto / goals[source], h, i, s, size))
    left, taken = int(1.5 * sum(sizes.values())), {}
    for _, h, i, s, size in sorted(items, key=lambda x: x[:3]):
        if size > left:
            break
        left -= size
        taken[s, h, i] = taken.get((s, h, i), 0) + size
    return taken


def test_taken_against_a_plain_queue(spark):
    docs = spark.createDataFrame([(i, sentence(i, i % 40), "en", ["a", "b", None, "a", "d"][i % 5], 0) for i in range(300)], DOC)
    got = {(r.source, r.h, r.doc_id): r for r in mix.shares(docs).collect()}
    want = brute_queue([(*k, r.size) for k, r in got.items()])
    assert len(got) == 300 and {k: r.taken for k, r in got.items() if r.taken} == want


@pytest.mark.parametrize("copies", [3, 4])
def test_a_large_group_of_equal_rows(spark, monkeypatch, copies):
    monkeypatch.setattr(mix, "COPIES", copies)  # so that 60 copies need all steps
    docs = spark.createDataFrame([(7, "one two three", "en", "a", 0)] * 60 + [(i, sentence(i, 9), "en", "b", 0) for i in range(100, 130)], DOC)
    rows = mix.shares(docs).collect()
    assert len(rows) == 90 and sum(r.doc_id == 7 for r in rows) == 60
    small = [r for r in rows if r.doc_id == 7]
    assert {r.source_size for r in small} == {180} and abs(sum(r.taken for r in small) - small[0].target) <= 3
    out = mix.mixture(docs)
    assert out.filter("doc_id = 7").count() * 3 == sum(r.taken for r in small)
    numbers = mix.numbered(spark.createDataFrame([(1, 61), (2, 1), (3, copies), (4, copies + 1)], "k long, n long"), "n", "j", ["k"], 61)
    got = numbers.groupBy("k").agg(F.sort_array(F.collect_list("j")).alias("j")).collect()
    assert {r.k: r.j for r in got} == {k: list(range(1, n + 1)) for k, n in ((1, 61), (2, 1), (3, copies), (4, copies + 1))}
