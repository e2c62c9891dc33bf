"""The pipeline stage by stage against plain versions, and without its parts."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellumine import scratch
from vellumine.llm import mix, quality

from .test_cases import CLASH, DOC, LONG, brute_hits, sentence
from .test_mix import brute_queue
from .test_simhash import changed

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    good = [(i, sentence(i, 60 + i).capitalize() + ".", "en", f"s{i % 3}", 0) for i in range(120)]
    near = [(1000 + i, changed(good[i][1], 1, i), "en", "s1", 0) for i in range(20)] + [(2000 + i, good[i][1], "en", "s2", 0) for i in range(20)]
    leaks = [(3000 + i, f"{sentence(500 + i, 30)} {sentence(900, 25)} {sentence(600 + i, 30)}.", "en", "s0", 0) for i in range(5)]
    junk = [(4000 + i, " ".join(w.upper() + "!!" for w in sentence(i, 60).split()), "en", "s0", 0) for i in range(120)]
    odd = [(5000, None, None, None, None), (5001, "", "en", "s0", 0), (None, sentence(77, 50), "en", "s1", 0), (5002, LONG, "en", "s2", 0), (7, good[7][1], "en", "s1", 0)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(good + near + leaks + junk + odd, DOC).repartition(3).write.parquet(str(out / "documents.parquet"))
    marks = [(r[0], int(r[0] < 4000), 0) for r in good + junk]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    spark.createDataFrame([(1, sentence(900, 25)), (2, None), (3, "")], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out)


def test_each_stage_against_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = (docs, scratch.written(stage(spark, docs, folder)))
        docs = steps[name][1]
    before, after = steps["quality classifier"]
    model = quality.fit(before, spark.read.parquet(f"{folder}/labels.parquet"))
    import pyarrow as pa

    rows = before.collect()
    scores = model.score(quality.statistics(pa.array([r.text or "" for r in rows], pa.string())))
    assert sorted(map(str, after.collect())) == sorted(str(r) for r, s in zip(rows, scores, strict=True) if s >= quality.CUT)
    ids = {r.doc_id for r in after.collect()}
    assert len([i for i in ids if i is not None and 4000 <= i < 5000]) <= 6 and len([i for i in ids if i is not None and i < 120]) >= 114

    before, after = steps["SimHash near-dedup"]
    had, kept = [r.doc_id for r in before.collect()], [r.doc_id for r in after.collect()]
    groups = [{i, 1000 + i, 2000 + i} for i in range(20)]
    assert all(min(g & set(had)) in kept and len(g & set(kept)) == 1 for g in groups if g & set(had))
    assert len(kept) == len(set(kept)) and {i for i in had if i is not None and not any(i in g for g in groups)} - set(kept) <= {5001}  # empty like 5000

    before, after = steps["benchmark decontamination"]
    items = [(1, sentence(900, 25))]
    assert sorted(str(r) for r in after.collect()) == sorted(str(r) for r in before.collect() if not brute_hits(r.text, items)[1])

    before, after = steps["mixing sources"]
    places = {(r.source, r.h, r.doc_id): r.size for r in mix.shares(before).collect()}
    want = brute_queue([(s, h, -1 if i is None else i, n) for (s, h, i), n in places.items()])
    times = {}
    for r in after.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    taken = {}
    for (_, _, i), n in want.items():
        taken[None if i == -1 else i] = n
    assert times == {i: n // next(size for (_, _, k), size in places.items() if k == i) for i, n in taken.items()}

    before, after = steps["sharding"]
    plain = lambda df: sorted(str(tuple(r)) for r in df.select(before.columns).collect())
    assert plain(before) == plain(after) and after.columns == [*before.columns, "shard", "slot"]
    per = {r.shard: (r.n, r.a, r.b) for r in after.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()}
    assert all(a == 0 and b == n - 1 for n, a, b in per.values()) and max(n for n, _, _ in per.values()) - min(n for n, _, _ in per.values()) <= 1


def test_run_leaves_only_its_result(spark, folder):
    since = scratch.made()
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    left = [p for p in scratch._made[since:] if scratch.hadoop_path(spark, p)[1].exists(scratch.hadoop_path(spark, p)[0])]
    assert left == [out._scratch_path]
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_stages_on_empty_tables_and_clashing_columns(spark, folder):
    empty = spark.createDataFrame([], DOC)
    clash = spark.createDataFrame([], DOC + CLASH)
    some = spark.read.parquet(f"{folder}/documents.parquet").limit(60).withColumns({c: F.lit("x") for c in ("h", "fp", "component_id", "record", "_score", "_hits", "i", "k", "_times", "bucket", "keys")})
    for _, stage in corpus_pipeline.STAGES:
        for docs in (empty, clash, some):
            got = stage(spark, docs, folder)
            assert [c for c in got.columns if c not in ("shard", "slot")] == [c for c in docs.columns if c not in ("shard", "slot")]
            assert got.count() <= 2 * docs.count()


@pytest.mark.parametrize("missing", ["vellumine.llm", "corpus_pipeline", "tiktoken", "xxhash"])
def test_entry_points_without_the_operators(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(s) <= set(q) and not [n for n in q if n[:2] == 'op' or n == 'pipeline'], q"
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0 and "left out" in got.stderr, got.stderr


