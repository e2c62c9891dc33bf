"""Sets of many, long and equal items."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vellumine.llm import decontam

from .test_cases import DOC, brute_hits, sentence


def test_items_that_share_windows(spark):
    shared = sentence(1, 30)
    bench = [(i, f"{sentence(i, 12)} {shared} {sentence(i + 50, 12)}") for i in range(40)] + [(99, shared), (99, sentence(7, 300)), (100, "tau tau"), (101, "tau tau")]
    docs = [(0, f"{shared} {shared} {shared}", "en", "s", 0), (1, sentence(7, 300)[40:900], "en", "s", 0), (2, "Tau, TAU!", "en", "s", 0), (3, "none of it", "en", "s", 0)]
    table = spark.createDataFrame(bench, "item_id long, text string")
    clash = spark.createDataFrame(docs, DOC).withColumns({c: F.lit("x") for c in ("_n_words", "_hits", "_items", "items", "n_hit", "i", "t")})
    for r in decontam.report(clash, table).collect():
        want = brute_hits(next(t for i, t, *_ in docs if i == r.doc_id), bench)
        assert (r.n_words, r.n_hit, set(r["items"])) == want and len(r["items"]) == len(set(r["items"])) and r.contaminated == (want[1] > 0)


def test_long_items_are_cut_without_losing_windows(spark):
    text = sentence(3, 2000)
    bench = spark.createDataFrame([(1, text), (2, "few words"), (3, None)], "item_id long, text string")
    for piece in (1, 7, 500, 5000):
        got = decontam._pieces(bench, 10, "item_id", "text", piece).collect()
        grams = {(r.i, tuple(r.t.split()[k : k + 10])) for r in got for k in range(max(1, len(r.t.split()) - 9))}
        words = text.split()
        assert grams == {(1, tuple(words[k : k + 10])) for k in range(len(words) - 9)} | {(2, ("few", "words"))}


def test_set_of_a_large_block_stays_small():
    rng = np.random.default_rng(0)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 200))) for _ in range(2000)]
    grams = decontam.GramSet(list(range(2000)), texts)
    hashes, places, ptr, items = grams.tables[10]
    held = sum(x.nbytes for x in (hashes, places, ptr, items, grams.codes)) + grams.vocab.nbytes
    assert len(hashes) == 2000 * 191 and held < 8 * sum(map(len, texts))
    assert grams.scan(pa.array(texts[:1]))[2].tolist() == [[0], [0]]
