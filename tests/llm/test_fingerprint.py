"""All columns of all rows against a plain version."""

import hashlib
import unicodedata

import pytest
import xxhash
from pyspark.sql import functions as F

from vellumine.llm import fingerprint

from .test_cases import DOC, TEXTS


def plain_form(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def brute(rows: list[tuple]) -> list[tuple]:
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        other = text[: len(text) - n] + following[:n]
        mark = lambda t: xxhash.xxh3_128_hexdigest(plain_form(t).encode())
        out.append((i, len(text), hashlib.sha256(other.encode()).hexdigest(), mark(text), mark(other), float(mark(text) == mark(other)), float(mark(text) == mark(following))))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_all_rows_against_brute_force(spark, partitions):
    texts = [*TEXTS, *TEXTS[:4], *[f"row {i % 7} of \u00c9\ufb01" for i in range(60)]]
    docs = spark.createDataFrame([(5 * i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC).repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fingerprint.fingerprints(docs.withColumns({c: F.lit("x") for c in ("h", "part", "edge", "then", "following")})).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = brute([(5 * i, t or "") for i, t in enumerate(texts)])
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == want
