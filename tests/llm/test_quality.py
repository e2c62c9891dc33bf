"""Statistics and trees against plain versions; labels of rows that share an id."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumine.llm import quality

from .test_cases import DOC, LONG, TEXTS, sentence


def plain_statistics(text: str) -> list[float]:
    data = text.encode()
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", data), data.split(b"\n")
    n, w = max(1, len(data)), max(1, len(words))
    out = [sum(c in own for c in data) / n for own in quality.CLASSES.values()]
    odd = b"".join(quality.CLASSES[k] for k in ("bang", "bar", "sign"))
    again = sum(a == b for a, b in zip(words, words[1:]))  # noqa: B905
    return [
        *out, math.log1p(len(words)), sum(map(len, words)) / w, len(set(words)) / w, max((words.count(x) for x in set(words)), default=0) / w, again / w,
        sum(x[-1] in odd for x in words) / w, sum(x[0] in quality.CLASSES["upper"] for x in words) / w, len(words) / len(lines), len(set(lines)) / len(lines), sum(len(x) > 25 for x in words) / w,
    ]


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_statistics_against_a_plain_version(monkeypatch, chunk):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    texts = [t or "" for t in TEXTS if t != LONG] + ["a\na\nb", "Spam!! spam!! 12%", "x" * 40, "\n\n", "É é|"]
    got = quality.statistics(pa.array(["left out", *texts]).slice(1))
    assert got.shape == (len(texts), len(quality.STATISTICS))
    for row, text in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx(plain_statistics(text)), text


def test_trees_against_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.random((600, 4))
    model = quality.boosted(x, (x[:, 0] * x[:, 1] > 0.25).astype(float), trees=12)
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.base
        for features, cuts, values in zip(model.features, model.cuts, model.values, strict=True):
            k = 0
            while k < len(features):
                k = 2 * k + (2 if row[features[k]] > cuts[k] else 1)
            total += values[k - len(features)]
        assert got == pytest.approx(1 / (1 + math.exp(-total)))


def test_rows_that_share_a_labelled_id_teach_once(spark, monkeypatch):
    rows = [(i, sentence(i, 30), "en", "s", 0) for i in range(30)]
    hot = spark.createDataFrame(rows + [(1, sentence(k, 40), "en", "s", 0) for k in range(500)], DOC)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    seen, fitted = [], quality.boosted
    monkeypatch.setattr(quality, "boosted", lambda x, y: seen.append(len(x)) or fitted(x, y))
    a, b = quality.fit(hot, labels), quality.fit(hot.orderBy(F.xxhash64("text")).repartition(5), labels)
    assert seen[0] == seen[1] <= 30 and np.array_equal(a.values, b.values)
