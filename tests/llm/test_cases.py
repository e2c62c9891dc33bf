"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import itertools
import re
import time
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vellumine.llm import attention, components, decontam, fingerprint, html_main, lm, mix, quality, quotes, shard, simhash, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", shard int, _hits string, _score string, record string, fp string, h string, _h string, bucket string, part int"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


BASE = sentence(1, 120)
NEAR = " ".join([*BASE.split()[:-1], "omega"])
TEXTS = [BASE, BASE, NEAR, None, "", "  ", "word", "two words", LONG, sentence(2, 90), sentence(3, 90), sentence(4, 11), "Straße ﬁn É", "STRASSE fin é", "a\x1cb c d", "!!! ###"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", "s0", 5), (3, "same id, other text", "en", "s1", 0), (9, TEXTS[9], "en", "s0", len(TEXTS[9]))]
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", F.lit(7).alias("shard"), *[F.lit("x").alias(c) for c in ("_hits", "_score", "record", "fp", "h", "_h", "bucket")], F.lit(1).alias("part"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def same_rows(a, b) -> bool:
    return sorted(map(str, a)) == sorted(map(str, b))


# --- simhash


def brute_fingerprint(text: str) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(docs):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    want = {}
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    label = list(range(len(fps)))
    for (i, (a, x)), (j, (b, y)) in itertools.combinations(enumerate(fps), 2):
        if a is not None and b is not None and (x ^ y).bit_count() <= 4 and label[i] != label[j]:
            old, new = label[j], label[i]
            label = [new if v == old else v for v in label]
    for i, (d, x) in enumerate(fps):
        members = [fps[k][0] for k in range(len(fps)) if label[k] == label[i] and fps[k][0] is not None]
        want.setdefault((d, x), min(members, default=None))
    for r in got:
        assert want[r.doc_id, r.fp % 2**64] == r.component_id or r.doc_id is None


def test_simhash_spark_hash_is_the_same(spark):
    d = spark.createDataFrame([("alpha beta gamma delta",)], "t string").select(F.xxhash64("t")).first()[0]
    assert d % 2**64 == xxhash.xxh64_intdigest("alpha beta gamma delta", 42)


@pytest.mark.parametrize("bucket", [8, 8192])
def test_links_against_brute_force(spark, bucket):
    rng = np.random.default_rng(bucket)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for c in centres]))
    reps = spark.createDataFrame([(int(f.view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    found = {(r.node, r.component_id) for r in components.components(simhash.links(reps, bucket=bucket)).collect()}
    label = np.arange(len(fps))
    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4), strict=True):
        label[label == max(label[i], label[j])] = min(label[i], label[j])
    assert found == {(i, int(v)) for i, v in enumerate(label) if i != v}


def test_within_abandons_and_finds_all():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fps[7] = fps[200] ^ np.uint64(0b1111)
    q, lane = simhash.within(simhash.planes_of(fps), fps[:64])
    got = {(a, b) for a, b in zip(q.tolist(), lane.tolist(), strict=True) if b < 300}
    assert got == {(i, int(j)) for i in range(64) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(5, 5)]
    got = dict(components.components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**{i: 100 for i in range(101, 141)}, **{k: 7 for k in range(8, 60)}}


def test_keep_one(docs, clashing, empty):
    kept = simhash.keep_one(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and 2 not in ids and 9 in ids
    assert simhash.keep_one(clashing).columns == clashing.columns and simhash.keep_one(clashing).count() == len(kept)
    assert simhash.keep_one(empty).count() == 0


# --- decontamination


BENCH = [(1, sentence(2, 90)), (2, "two words"), (3, None), (4, "..."), (None, "word"), (5, BASE.upper()), (5, "iota?")]


def brute_hits(text: str, items: list) -> tuple[int, int, set]:
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = norm(text)
    hit, found = [False] * len(words), set()
    for i, t in items:
        w = norm(t)
        n = min(10, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1) if n else ():
            if tuple(words[k : k + n]) in grams:
                hit[k : k + n] = [True] * n
                found |= {i} - {None}
    return len(words), sum(hit), found


@pytest.mark.parametrize("block", [32 << 20, 300])
def test_decontamination_against_brute_force(spark, docs, block):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontam.scan(docs, bench, block_bytes=block)
    n_words, hits, items = found.columns[-3:]
    got = found.select("doc_id", "text", n_words, decontam.n_hit(hits).alias("n"), items).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r[2], r[3], set(r[4])) == brute_hits(r.text, BENCH)


def test_decontamination_outputs(spark, docs, clashing, empty):
    bench = spark.createDataFrame(BENCH[:2], "item_id long, text string")
    kept = decontam.drop_contaminated(clashing, bench)
    assert kept.columns == clashing.columns and kept.count() == docs.count() - 3  # both rows 9, and "two words"
    cut = {r.doc_id: r.text for r in decontam.remove_spans(docs, bench).collect()}
    assert cut[9] == "" and cut[7] == "" and cut[0] == BASE and cut[3] in (None, "same id, other text")
    assert decontam.remove_spans(empty, bench).count() == 0 and decontam.report(docs, bench.limit(0)).filter("contaminated").count() == 0


# --- fingerprints


def test_fingerprints(docs, empty, clashing):
    rows = fingerprint.fingerprints(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].fingerprint == by[1][0].fingerprint != by[2][0].fingerprint
    assert by[12][0].fingerprint == by[13][0].fingerprint
    assert by[0][0].near_next == 1.0 and by[4][0].near_edited == 1.0 and by[4][0].n_chars == 0
    text, following = TEXTS[10], TEXTS[11]
    want = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
    assert by[10][0].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.fingerprints(clashing.filter("doc_id = 10")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprint_collisions_are_told_apart(docs):
    rows = fingerprint.fingerprints(docs.filter("doc_id is not null"), digest=lambda b: str(len(b) % 3)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.fingerprint, set()).add(r.doc_id)
    groups = {}
    for r in docs.filter("doc_id is not null").collect():
        groups.setdefault(fingerprint.canonical(r.text or ""), set()).add(r.doc_id)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, groups.values()))


def test_canonical():
    assert fingerprint.canonical("  A B\n") == b"a b" and fingerprint.canonical(unicodedata.normalize("NFD", "É")) == "é".encode()


# --- shards


def test_shards(docs, empty, clashing):
    rows = shard.shards(docs, 4).collect()
    assert same_rows([tuple(r)[:5] for r in rows], map(tuple, docs.collect()))
    by = {k: sorted(r.slot for r in rows if r.shard == k) for k in range(4)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert same_rows(rows, shard.shards(docs.repartition(2), 4).collect())  # the same whatever the partitions
    assert not same_rows(rows, shard.shards(docs, 4, seed=1).collect())
    out = shard.shards(clashing, 4)
    assert set(out.columns) == {*clashing.columns, "slot"} and out.count() == len(rows)
    assert shard.shards(empty).count() == 0


def test_shards_split_a_hot_bucket(spark):
    same = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x" * 50).alias("text"))
    mixed = shard.shuffled(same.union(spark.range(100).select("id", F.lit("y").alias("text"))), bucket_bytes=8000)
    assert mixed.groupBy("bucket", "part").count().agg(F.max("count")).first()[0] < 1000 and mixed.count() == 3100
    out = shard.shards(same, 7, bucket_bytes=8000)
    assert out.select("shard", "slot").distinct().count() == 3000


# --- mixing


def brute_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


def test_mix_targets(spark):
    sizes = {"b": 100, "a": 1000, None: 50, "z": 0, "é": 700, "c": 90}
    got = {r.source: r.target for r in mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_shares(spark, docs, empty):
    n = 400
    many = spark.createDataFrame([(i, sentence(i, 5 + i % 40), "en", ["hot", "b", None, "hot", "d"][i % 5], 0) for i in range(n)], DOC)
    many = many.union(spark.createDataFrame([(5, sentence(5, 10), "en", "hot", 0)] * 30, DOC))
    rows = mix.shares(many).collect()
    assert len(rows) == n + 30 and same_rows(rows, mix.shares(many.repartition(7)).collect())
    per, sizes = {}, {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        per[r.source] = per.get(r.source, 0) + r.taken
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.target == pytest.approx(brute_targets({x.source: x.source_size for x in rows})[r.source])
    assert all(abs(per[r.source] - r.target) <= 90 for r in rows) and sum(per.values()) <= 1.5 * sum(sizes.values())
    out = mix.mixture(many)
    assert out.columns == many.columns and out.select(F.sum(mix.n_words(F.col("text")))).first()[0] == sum(per.values())
    assert mix.shares(empty).count() == 0 and mix.mixture(empty).count() == 0
    edge = mix.shares(docs).collect()
    assert len(edge) == docs.count() and all(r.taken == 0 for r in edge if r.size == 0)


def test_mix_keeps_clashing_columns(clashing):
    assert mix.mixture(clashing).columns == clashing.columns and mix.mixture(clashing).count() > 0


# --- quality


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boosted(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.95
    assert quality.boosted(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality.boosted(x, np.ones(3000)).score(x[:1])[0] > 0.9


def test_quality(spark, docs, clashing, empty):
    good = [(i, sentence(i, 60).capitalize() + ".", "en", "s", 0) for i in range(200)]
    bad = [(i + 200, " ".join(w.upper() + "!!" for w in sentence(i, 60).split()), "en", "s", 0) for i in range(200)]
    table = spark.createDataFrame(good + bad, DOC)
    labels = spark.createDataFrame([(r[0], int(r[0] < 200), 0) for r in good + bad] + [(1, None, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(table, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == (r.doc_id < 200) for r in rows if r.held_out]) > 0.95
    kept = quality.accepted(table, labels)
    assert kept.columns == table.columns and kept.filter("doc_id >= 200").count() <= 10 and kept.filter("doc_id < 200").count() >= 190
    edge = quality.quality(docs, labels).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in edge)
    assert quality.accepted(clashing, labels).columns == clashing.columns
    assert quality.quality(empty, labels).count() == 0 and quality.quality(docs, labels.limit(0)).filter("score = 0.5").count() == docs.count()


# --- pages


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>" + BASE + "</p><p>Short &amp; sweet<br>line</p></article><footer>Foot</footer>", "Head\n\n" + BASE + "\n\nShort & sweet line"),
    ("<body><div class='menu'><p>One</p></div><div><p>" + BASE + "<p>" + NEAR + "</div><div id=comments><p>" + BASE + "</p></div><script>var x='<p>no</p>';</script>", BASE + "\n\n" + NEAR),
    ("<article><p>Tiny.</p></article>", "Tiny."), ("plain text only", "plain text only"), ("", ""), (None, ""), ("<p>a<!-- <p>b</p> -->c</p>", "ac"),
    ("<article><header><h1>T</h1><p>by X</p></header><p>Body text.</p><aside>See also</aside><form><p>Mail</p></form><p>End", "T\n\nBody text.\n\nEnd"), ("<div class=ad>Buy</div>", ""), ("<p>x < y &#233;&nbsp;z</p>", "x < y é z"),
]


def test_html(spark):
    p = spark.createDataFrame([(i, f"u{i}", h, 1) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html_main.extract(p).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}
    assert html_main.extract(p.limit(0)).count() == 0


def test_line_blocks_without_an_article_element():
    noise = "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(8))
    page = f"<body>{noise}<br><div><h2>Title of it</h2><p>{BASE}</p><p>Short.</p><p>{NEAR}</p></div>{noise}"
    assert html_main.main_text(page) == "\n\n".join(["Title of it", BASE, "Short.", NEAR])


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<main><h1>Head</h1><article><p>{BASE}</p></article><p>{NEAR}</p></main>", ["Head", BASE, NEAR]),
        (f"<article><h2>One</h2><p>{BASE}</p></article><article><h2>Two</h2><p>{NEAR}</p></article>", ["One", BASE, "Two", NEAR]),
        (f"<article><h2>Outer</h2><p>{BASE}</p><article><p>{NEAR}</p></article><p>After it.</p></article>", ["Outer", BASE, NEAR, "After it."]),
        (f"<article><p>{BASE}</p><main><p>{NEAR}</p></main></article>", [BASE, NEAR]),
        (f"<main><article><p>{BASE}</p></article><article><p>{NEAR}</p></article></main>", [BASE, NEAR]),
    ],
)
def test_outermost_article_or_main(body, want):
    noise = "<nav><a href=/>Menu</a></nav>"
    assert html_main.main_text(f"<body>{noise}<p>Outside</p>{body}<p>Outside</p><footer>Foot</footer>") == "\n\n".join(want)


def brute_stretches(sizes: list[int], window: int, surge: int) -> list[tuple[int, int, int, bool]]:
    """Sums of all windows, also of those over the ends; lines are of one stretch unless a window of zero is between them."""
    wide = [0] * window + sizes + [0] * window
    sums = {i: sum(wide[i + window : i + 2 * window]) for i in range(-window, len(sizes) + 1)}
    full = [i for i, n in enumerate(sizes) if n]
    groups = []
    for i in full:
        if groups and not any(sums[k] == 0 for k in range(groups[-1][-1] + 1, i)):
            groups[-1].append(i)
        else:
            groups.append([i])
    return [(g[0], g[-1] + 1, sum(sizes[g[0] : g[-1] + 1]), any(sums[k] > surge for k in range(g[0] - window + 1, g[-1] + 1))) for g in groups]


def test_stretches_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(400):
        sizes = (rng.integers(0, 60, rng.integers(0, 40)) * (rng.random() < rng.random(1))).tolist()
        sizes = [n if rng.random() < 0.4 else 0 for n in sizes]
        for window, surge in ((1, 30), (3, 86), (4, 10)):
            assert html_main.stretches(sizes, window, surge) == brute_stretches(sizes, window, surge)


def test_text_of_several_surges_and_of_none():
    gap = "<div class=ad><p>a</p><p>b</p><p>c</p></div>"
    page = f"<nav><p>Menu</p></nav>{gap}<div><p>Lead.</p><p>{BASE}</p></div>{gap}<div><p>{NEAR}</p></div>{gap}<p>Odd</p>"
    assert html_main.main_text(page) == "\n\n".join(["Lead.", BASE, NEAR])
    assert html_main.main_text(f"<article><p>{BASE}</p></article>{gap}<div><p>{NEAR}</p></div>") == BASE  # stands otherwise than the article
    assert html_main.main_text(f"<article><p>{BASE}</p>{gap}<p>{NEAR}</p></article>") == f"{BASE}\n\n{NEAR}"
    assert html_main.main_text("<div class=ad>Buy this</div><p>Few words.</p><p>More.</p>") == "Few words.\n\nMore."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<nav><p>Never closed</p><p>at all", "Never closed\n\nat all"), ("<p>ok</p><a x='", "ok"), ('<p title=O\'Brien>one</p><p title="a > b">two</p>', "one\n\ntwo"),
        ("<p>a<script>if (a</b) x='</p>'</script>b</p>", "a b"), ("<p>a</p><script>never ended <p>b</p>", "a"), ("<ul><li class=ad>Buy<li>Stay</ul>", "Stay"),
        ("<p>x<button>Press</button>y</p>", "xy"), ("<p>one<p class='comment'>two<p>three", "one\n\nthree"), ("<p>&lt;b&gt; &amp;amp;</p>", "<b> &amp;"), ("</div></p><p>a</p></ul>", "a"),
    ],
)
def test_html_as_browsers_read_it(page, want):
    assert html_main.main_text(page) == want


EVIL = {
    "attributes": "<p>hello world</p><a " + 'x="y" ' * 170_000, "unclosed": "<div class=nav>" * 70_000, "quotes": '<a x="' * 150_000, "mixed": "<a b='<a b=\"" * 80_000, "less": "<" * 10**6, "comments": "<!-" * 300_000,
    "equals": "<a " + "=" * 10**6, "scripts": "<script>" * 120_000, "paragraphs": "<p>" * 300_000 + "x", "ends": "</div>" * 150_000, "deep": "<nav>" * 90_000 + "</nav>" * 90_000, "classes": "<a " + "class = " * 120_000 + ">", "links": "<a>x" * 200_000,
}


@pytest.mark.parametrize("kind", EVIL)
def test_html_of_a_megabyte_takes_no_time(kind):
    began = time.process_time()
    html_main.main_text(EVIL[kind])
    assert time.process_time() - began < 2


def test_html_long_repeated_and_clashing(spark):
    page = "<article>" + "".join(f"<p>{sentence(i, 60)}</p>" for i in range(3000)) + "</article>"
    p = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, "<p>a</p>")], "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "_h", "n_chars")})
    rows = html_main.extract(p).collect()
    assert len(rows) == 3 and [len(r.text.split("\n\n")) for r in rows if r.page_id == 1] == [3000, 3000]


# --- WARC


def test_warc_round_trip(spark):
    big = "<p>" + LONG + "</p>"
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "http://c", big), (4, "u", "x"), (5, "u", "x"), (6, "u", None), (7, "u", ""), (None, "u", "é" * 700), (8, "u", "\x1f\x8b\x08 not a member"), (3, "http://c", big)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = warc.write_archives(p, archive_bytes=50_000)
    for split in (97, 8 << 20):
        got = warc.read_archives(found, split).collect()
        assert len(got) == len(rows)
        for r in got:
            html = next(h for i, _, h in rows if i == r.page_id) or ""
            assert r.payload_digest == hashlib.sha1(html.encode()).hexdigest() and r.payload_bytes == len(html.encode())
            assert (r.record_type, r.refers_to) == (("revisit", 3) if r.page_id in (1, 2) else ("response", None))
            assert r.record_type == "revisit" or bytes(r.payload) == html.encode()
    assert warc.round_trip(p.limit(0)).count() == 0


def brute_records(data: bytes) -> list[int]:
    """Where the records of an archive begin, read from the first byte to the last."""
    places, at = [], 0
    while at < len(data):
        if data[at] in warc.PADDING:
            at += 1
            continue
        one = zlib.decompressobj(31)
        one.decompress(data[at:])
        places.append(at)
        at = len(data) - len(one.unused_data)
    return places


def read_split(path, split: int) -> list[int]:
    n = path.stat().st_size
    return [place for a in range(0, n, split) for place, _, _ in warc.records_in(str(path), a, min(n, a + split))]


DATE = "2026-01-01T00:00:00Z"


def one_record(i: int, text: str) -> bytes:
    return warc.record(i, f"http://h/{i}", text.encode(), None, False, DATE)


@pytest.mark.parametrize("gap", [b"", b"\0\0", b"\n", b"\r\n\r\n"])
def test_warc_split_reading_equals_sequential(tmp_path, gap):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(gap.join(one_record(i, sentence(i, 1 + 40 * i)) for i in range(9)) + gap)
    want = brute_records(path.read_bytes())
    assert len(want) == 9
    for split in (1, 7, 100, 1000, 1 << 20):
        assert read_split(path, split) == want


def test_warc_damage_is_an_error(tmp_path):
    parts = [one_record(i, sentence(i, 200)) for i in range(6)]
    whole = b"".join(parts)
    first = len(parts[0])
    damaged = {"cut": whole[:-20], "cut after padding": b"\n".join(parts)[:-20], "magic": whole[:first] + b"x" + whole[first + 1 :], "middle": whole[: first + 60] + b"\xff" * 8 + whole[first + 68 :], "between": parts[0] + b"junk" + b"".join(parts[1:])}
    for name, data in damaged.items():
        path = tmp_path / "b.warc.gz"
        path.write_bytes(data)
        for split in (97, first, first + 1, 1 << 20):
            with pytest.raises(ValueError):
                read_split(path, split)
                pytest.fail(name)


def test_warc_large_member_and_counts(spark, tmp_path):
    rng = np.random.default_rng(0)
    path = tmp_path / "c.warc.gz"
    path.write_bytes(warc.record(1, None, rng.bytes(20 << 20), None, False, DATE) + one_record(2, "x"))  # hardly packed: many reads
    assert read_split(path, 1 << 20) == brute_records(path.read_bytes())
    manifest = spark.createDataFrame([(str(path), path.stat().st_size, 3)], "path string, size long, records long")
    with pytest.raises(ValueError, match="should have 3 records, but 2"):
        warc.check_counts(warc.read_archives(manifest), manifest)


def test_warc_revisits_name_record_ids(spark):
    big = "<p>" + sentence(5, 400) + "</p>"
    rows = [(1, "u", big), (9, "v", big), (9, "w", big), (4, "x", "small"), (5, "x", "small"), (None, "y", big + "!"), (None, "z", big + "!")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("d", "top", "refers_to", "path")})
    got = warc.read_archives(warc.write_archives(p, date=DATE)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (0, "response", 0), (1, "revisit", 9), (4, "response", 0), (5, "response", 0), (9, "response", 0), (9, "response", 0)]
    ids = {r.record_id: r for r in got if r.record_type == "response"}
    for r in got:
        assert (r.refers_to_id is None) == (r.record_type == "response")
        assert r.refers_to_id is None or (ids[r.refers_to_id].page_id, ids[r.refers_to_id].payload_digest) == (r.refers_to, r.payload_digest)


def test_warc_false_members_are_passed_over(tmp_path):
    inner = warc.record(9, None, b"inside", None, False, DATE)
    outer = warc.zlib.compressobj(0, 8, 31)  # stored, so the inner member's bytes stand in the file
    whole = outer.compress(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n") + outer.flush()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(whole + warc.record(10, None, b"next", None, False, DATE))
    ids = [f.get("page-id") for _, f, _ in warc.records_in(str(path), 1, path.stat().st_size)]
    assert ids == ["10"]


# --- quotes


def test_quotes(spark):
    first = "Shall we meet at the old mill on Monday?"
    rows = [
        (1, 0, "u", first), (1, 1, "a", f"> {first}\nYes, at nine in the morning would suit me."), (1, 2, "u", f">> {first}\n> Yes, at nine in the morning would suit me.\nGood.\n\nOn Monday, X wrote:\n> nothing that anyone said here before"),
        (2, 0, "u", "> Yes, at nine in the morning would suit me.\nWho asked?"), (3, 0, "u", None), (3, 1, "a", ""), (4, 0, "u", "Good."), (4, 0, "u", "Good."), (None, 1, "u", "> Good."), (5, None, "u", "x"),
        (6, 0, "u", "Line one of a longer message here.\nAnd a second line that is quoted alone."), (6, 1, "a", "> and a  SECOND line that is quoted alone.\nI see."),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_h", F.lit("x")).withColumn("position", F.lit("y"))
    got = quotes.conversations(m).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].text == "Yes, at nine in the morning would suit me." and (by[1, 1].parent_thread, by[1, 1].parent_order) == (1, 0)
    assert (by[1, 2].parent_order, by[1, 2].n_quoted, by[1, 2].n_linked, by[1, 2].text) == (1, 3, 2, "Good.")
    assert (by[2, 0].parent_thread, by[2, 0].parent_order, by[2, 0].conversation_id) == (1, 1, 1)
    assert [by[k].position for k in ((1, 0), (1, 1), (1, 2), (2, 0))] == [0, 1, 2, 3]
    assert by[6, 1].parent_order == 0 and by[3, 0].text == "" and by[None, 1].position is None and by[5, None].parent_thread is None
    assert sorted(r.position for r in got if r.conv_id == 4) == [0, 1]
    assert quotes.conversations(m.limit(0)).count() == 0


def test_replies_between_quotes_are_found(spark):
    one, two = "Is the old mill open on Monday?", "Is it warm?"
    rows = [
        (1, 0, f"{one}\n{two}"), (1, 1, f"> {one}\nYes.\n> {two}\nNo,\nit is not."),
        (1, 2, f">> {one}\n> Yes.\n>> {two}\n> No,\n> it is not.\nFine then."), (1, 3, "> No, it is not.\nA pity."), (2, 0, "> Fine then.\nWhat is?"),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    by = {(r.conv_id, r.turn): r for r in quotes.conversations(m).collect()}
    assert [by[1, k].parent_order for k in range(4)] == [None, 0, 1, 1]
    assert (by[1, 2].n_quoted, by[1, 2].n_linked) == (4, 3)
    assert by[2, 0].parent_order == 2 and by[2, 0].conversation_id == 1


# --- language model


RANKS = b"\n".join([*(warc.base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)), warc.base64.b64encode(b"al") + b" 256", warc.base64.b64encode(b"ta") + b" 257"])


def test_attention_gradients():
    from vellumine.llm import attention as A

    rng = np.random.default_rng(0)
    p = {k: v.astype("f8") for k, v in A.initial(rng).items()}
    inputs, slots, valid = rng.integers(0, 9, (3, A.WINDOW)), rng.integers(0, A.CLASSES, (3, A.WINDOW)), rng.random((3, A.WINDOW)) < 0.8
    _, g = A.gradients(p, inputs, slots, valid)
    for k, w in p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        old = w[at]
        w[at] = old + 1e-5
        up = A.gradients(p, inputs, slots, valid)[0]
        w[at] = old - 1e-5
        down = A.gradients(p, inputs, slots, valid)[0]
        w[at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[k][at], rel=1e-4)


@pytest.mark.parametrize("share", [0.97, 0.0])
def test_gradients_where_nearly_all_places_have_targets_or_none(share):
    """Places without a target are kept among the others or left out, with the same gradients."""
    rng = np.random.default_rng(5)
    p = {k: v.astype("f8") for k, v in attention.initial(rng).items()}
    inputs, slots, valid = rng.integers(0, 9, (4, attention.WINDOW)), rng.integers(0, attention.CLASSES, (4, attention.WINDOW)), rng.random((4, attention.WINDOW)) < share
    assert valid.mean() == share or 0.9 < valid.mean() < 1
    loss, g = attention.gradients(p, inputs, slots, valid)
    padded = [np.concatenate((x, np.zeros_like(x))) for x in (inputs, slots, valid)]  # so many without that they are left out
    again, h = attention.gradients(p, *padded)
    assert again == pytest.approx(loss)
    for k, w in p.items():
        assert np.allclose(g[k], h[k], atol=1e-12)
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        old, ends = w[at], []
        for step in (1e-5, -1e-5):
            w[at] = old + step
            ends.append(attention.gradients(p, inputs, slots, valid)[0])
        w[at] = old
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[k][at], rel=1e-4)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 300, 1024])
def test_products_by_runs_are_plain_products(n):
    rng = np.random.default_rng(n)
    x, y, w = rng.standard_normal((n, 32)), rng.standard_normal((n, 96)), rng.standard_normal((96, 32))
    assert np.allclose(attention.product(x, w.T), x @ w.T) and np.allclose(attention.product(y, w), y @ w)
    assert np.allclose(attention.across(x, y), x.T @ y)


def test_training_windows_place_by_place():
    rng, lengths = np.random.default_rng(7), np.array([1, 31, 32, 33, 56, 57, 200, 1])
    classes, ends = rng.integers(0, attention.CLASSES, lengths.sum()), np.cumsum(lengths)
    starts, text = attention.windows(lengths)
    got = attention.training_windows(classes, starts, ends[text], (ends - lengths)[text])
    for row, at, t in zip(got.tolist(), starts, text, strict=True):
        own = [int(classes[i]) if i < ends[t] else -1 for i in range(at, at + attention.WINDOW)]
        assert row == [attention.START if at == ends[t] - lengths[t] else int(classes[at - 1]), *own]
    assert attention.training_windows(classes[:0], starts[:0], starts[:0], starts[:0]).shape == (0, attention.WINDOW + 1)


def test_one_softmax_for_all_groups(monkeypatch):
    """A chunk's targets are scored in one pass, not in one for each of the groups."""
    rng, calls, plain = np.random.default_rng(6), [], attention.log_softmax_at
    monkeypatch.setattr(attention, "log_softmax_at", lambda logits, at: calls.append(len(at)) or plain(logits, at))
    p, states, slots = attention.initial(rng), rng.standard_normal((500, attention.WIDTH)).astype("f4"), rng.integers(0, attention.CLASSES, 500)
    got = attention.token_logs(p, states, slots)
    assert calls == [1000]
    for i in range(0, 500, 50):
        c, m = divmod(slots[i], attention.MEMBERS)
        group, member = states[i] @ p["group"] + p["group_b"], states[i] @ p["member"][c] + p["member_b"][c]
        assert got[i] == pytest.approx(group[c] - np.log(np.exp(group).sum()) + member[m] - np.log(np.exp(member).sum()), abs=1e-4)


def test_states_of_some_places_are_those_of_all():
    rng = np.random.default_rng(2)
    p, inputs = attention.initial(rng), rng.integers(0, attention.CLASSES, (5, attention.WINDOW))
    rows = np.array([159, 0, 31, 32, 77])
    assert np.allclose(attention.attend(p, inputs, rows)[0], attention.attend(p, inputs)[0][rows], atol=1e-5)


def test_training_is_plain_adam_over_all_windows():
    """Windows go through Spark as bytes and come back the same; steps over one flat vector equal those weight by weight."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, attention.CLASSES, (150, attention.WINDOW + 1)).astype("<i2")
    rows[::7, 20:] = -1  # texts that end within their window
    sent = lm._of_one_size(rows)
    assert sent.to_pylist() == [r.tobytes() for r in rows]
    assert (lm._joined(sent.slice(10, 50)).view("<i2").reshape(-1, attention.WINDOW + 1) == rows[10:60]).all()
    slot, start = rng.permutation(attention.CLASSES), attention.fresh_state()
    kept = {k: w.copy() for k, w in start[0].items()}
    p, m, v = ({k: w.copy() for k, w in x.items()} for x in start)
    for n, at in enumerate(attention.turns(len(rows), 6, (attention.SEED, 0)), 1):
        batch = rows[at].astype(np.int64)
        _, g = attention.gradients(p, np.where(batch[:, :-1] >= 0, batch[:, :-1], attention.END), slot[batch[:, 1:]], batch[:, 1:] >= 0)
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.002 * (g[k] * g[k] - v[k])
            rate = attention.RATE * n / 100 * 0.5 * (1 + np.cos(np.pi * n / 6))
            p[k] -= rate / (1 - 0.9**n) * m[k] / (np.sqrt(v[k] / (1 - 0.998**n)) + 1e-8)
    got = attention.trained_on(rows, slot, start, 0, 6, 6)
    for x, y in zip(got, (p, m, v), strict=True):
        assert all(np.allclose(x[k], y[k], atol=1e-5) for k in y)
    assert all((start[0][k] == w).all() for k, w in kept.items())


def test_hidden_layer_is_twice_the_width():
    from vellumine.llm import attention as A

    p = A.initial(np.random.default_rng(0))
    assert p["in"].shape == (A.WIDTH, 2 * A.WIDTH) and p["up"].shape == (2 * A.WIDTH, A.WIDTH)


def test_scoring_windows_match_full_attention():
    from vellumine.llm import attention as A

    rng = np.random.default_rng(1)
    p = A.initial(rng)
    slot_of, lengths = rng.permutation(A.CLASSES), np.array([1, 31, 32, 33, 100])
    classes = rng.integers(0, A.CLASSES, lengths.sum())
    got = A.sequence_logs(p, slot_of, classes, lengths)
    at = 0
    for n in lengths:
        own = classes[at : at + n]
        x = np.concatenate(([A.START], own[:-1]))
        starts = [0, *range(A.WINDOW - A.OVERLAP, max(1, n - A.OVERLAP), A.WINDOW - A.OVERLAP)]
        for s in starts:
            window = np.resize(x[s : s + A.WINDOW], (1, A.WINDOW))
            y, _ = A.attend(p, window)
            for i in range(0 if s == 0 else A.OVERLAP, min(A.WINDOW, n - s)):
                group = y[i] @ p["group"] + p["group_b"]
                slot = slot_of[own[s + i]]
                member = y[i] @ p["member"][slot // A.MEMBERS] + p["member_b"][slot // A.MEMBERS]
                want = group[slot // A.MEMBERS] - np.log(np.exp(group).sum()) + member[slot % A.MEMBERS] - np.log(np.exp(member).sum())
                assert got[at + s + i] == pytest.approx(want, abs=1e-4)
        at += n


@pytest.mark.parametrize("blocks", [1, 3, 1 << 14])
def test_lm_scores(docs, empty, monkeypatch, blocks):
    monkeypatch.setattr(lm, "BLOCKS_A_WORD", blocks)
    marked = docs.select("doc_id", "text", (lm.fold(F.col("doc_id")) == 1).alias("held_out"))
    model = lm.fit(marked, RANKS, steps=5)
    got = {}
    for block in (2000, 8 << 20):  # several blocks or one: the same counts
        rows = lm.scores(marked, model, block_bytes=block).collect()
        assert len(rows) == docs.count()
        got[block] = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in rows)
    assert got[2000] == got[8 << 20]
    counts, rows = {}, docs.collect()
    cut = lambda t: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + ["end"]
    for r in rows:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            for w in cut(r.text):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if r.doc_id is None else r.doc_id or -1, len(cut(r.text)), sum(w in counts for w in cut(r.text)), n, round(float(sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in cut(r.text))), 6)) for r in rows)
    assert [g[:5] for g in got[2000]] == want
    assert lm.scores(marked.limit(0), model).count() == 0
    only_held = marked.withColumn("held_out", F.lit(True))
    assert all(np.isfinite(r.score) and r.train_tokens == 0 for r in lm.scores(only_held, model).collect())


def test_words_are_put_together_again():
    code, words = attention.Subwords(RANKS), ["alta", "é", "x", "tal\x1c", "日本", "al" * 50]
    tokens, begin = code.tokens(words)
    assert attention.joined(attention.spellings(RANKS), tokens, np.diff(begin)).to_pylist() == words
    assert attention.joined(attention.spellings(RANKS), tokens[:0], np.diff(begin[:1])).to_pylist() == []


def test_whole_score_against_brute_force(spark, docs):
    """The mixture word by word: the attention model's share from a plain pass over each window, the counts from a Counter."""
    marked = docs.select("doc_id", "text", (lm.fold(F.col("doc_id")) == 1).alias("held_out")).filter("length(text) < 2000 or text is null")
    model = lm.fit(marked, RANKS, steps=20)
    rows = [(r.doc_id, [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode()))], r.held_out) for r in marked.collect()]
    counts = {None: 0}
    for _, words, held in rows:
        for w in () if held else [*words, None]:
            counts[w] = counts.get(w, 0) + 1
    total, code, want = sum(counts.values()), attention.Subwords(RANKS), []
    p, A = model.weights, attention
    for i, words, _ in rows:
        spelt = [(w, model.classes.of[code.tokens([w])[0]].tolist()) for w in words] + [(None, [A.END])]
        flat = [c for _, own in spelt for c in own]
        x, logs = np.array([A.START, *flat[:-1]]), []
        for s in [0, *range(24, max(1, len(flat) - 8), 24)]:
            y, _ = A.attend(p, np.resize(x[s : s + 32], (1, 32)))
            for k in range(len(logs) - s, min(32, len(flat) - s)):
                slot = model.classes.slot[flat[s + k]]
                group, member = y[k] @ p["group"] + p["group_b"], y[k] @ p["member"][slot // 32] + p["member_b"][slot // 32]
                logs.append(group[slot // 32] - np.log(np.exp(group).sum()) + member[slot % 32] - np.log(np.exp(member).sum()) + (model.classes.log_rare if flat[s + k] == A.RARE else 0))
        score, at = 0.0, 0
        for w, own in spelt:
            score += np.log10(lm.MIX * np.exp(sum(logs[at : at + len(own)])) + (1 - lm.MIX) * counts.get(w, 0) / total)
            at += len(own)
        want.append((i or -1, len(spelt), score))
    for block in (300, 8 << 20):
        got = [(r.doc_id or -1, r.n_tokens, r.score) for r in lm.scores(marked, model, block_bytes=block).collect()]
        for (a, n, x), (b, m, y) in zip(sorted(got), sorted(want), strict=True):
            assert (a, n) == (b, m) and x == pytest.approx(y, rel=1e-4)


def test_model_learns_from_all_training_texts(spark, monkeypatch):
    """Texts of any length count: classes and neighbours equal brute force, and windows come from a very long text too."""
    texts = ["ab ba ab", "a b ab", "", None, " ".join(["lang texte"] * 9000)]  # the last has over 16 KB
    df = spark.createDataFrame([(i, t, i == 1) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean").repartition(3)
    code = attention.Subwords(RANKS)
    tokens = [code.tokens(lm.words_of(t or ""))[0] for i, t in enumerate(texts) if i != 1]
    want = attention.Classes(tokens, code.size)
    got = lm.fit(df, RANKS, steps=2).classes
    assert (got.of == want.of).all() and (got.slot == want.slot).all()
    blocks = lm._blocks(df, RANKS, 2000)
    n = blocks.filter("idx = -1").agg(F.sum("n")).first()[0]
    assert n == len(attention.windows(np.array([len(t) + 1 for t in tokens]))[0])
    assert lm._learnt(blocks, got, 1.0).filter("kind = 1").count() == n
    assert 0.35 * n < lm._learnt(blocks, got, 0.5).filter("kind = 1").count() < 0.65 * n
    seen = []
    monkeypatch.setattr(lm, "_weights", lambda drawn, n, slot, steps: seen.append((n, drawn.count())))
    monkeypatch.setattr(lm, "PART_WINDOWS", 10)
    for times in (40, 400):  # more text, more windows
        lm._fit(lm._blocks(df.select("doc_id", F.expr(f"repeat(text, {times})").alias("text"), "held_out"), RANKS), RANKS, 2)
    assert seen[1][0] > 8 * seen[0][0] and seen[1][1] > 6 * seen[0][1]


@pytest.mark.parametrize("doc_id", [2, 7, None])
def test_model_learns_where_rows_share_a_doc_id(spark, doc_id):
    """As many rows as were once cut by a hash of doc_id alone: the windows drawn are about the share asked for."""
    ids = F.lit(doc_id).cast("long").alias("doc_id")
    df = spark.range(12_500).select(ids, F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"), F.lit(False).alias("held_out"))
    blocks = lm._blocks(df, RANKS)
    drawn = lm._learnt(blocks, attention.Classes([], attention.Subwords(RANKS).size), 0.25).filter("kind = 1").count()
    assert 2900 < drawn < 3350


def test_model_parts_learn_together(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_WINDOWS", 300)
    monkeypatch.setattr(lm, "WINDOW_SHARE", 1)
    df = spark.createDataFrame([(i, sentence(i, 400), False) for i in range(60)], "doc_id long, text string, held_out boolean").repartition(4)
    model = lm.fit(df, RANKS, steps=80)
    t = np.concatenate((model.classes.of[attention.Subwords(RANKS).tokens(lm.words_of(sentence(99, 300)))[0]], [attention.END]))
    loss = -attention.sequence_logs(model.weights, model.classes.slot, t, np.array([len(t)])).mean()
    assert loss < 0.8 * -attention.sequence_logs(attention.fresh_state()[0], model.classes.slot, t, np.array([len(t)])).mean()
    again = lm.fit(df.repartition(2), RANKS, steps=80)
    assert all(np.allclose(w, again.weights[k], atol=1e-3) for k, w in model.weights.items())


def test_weights_meet_every_window(spark, monkeypatch):
    """No share of the windows is left out however many there are: the rounds after the first hold each exactly once, and so do shuffled batches."""
    df = spark.createDataFrame([(i, sentence(i, 300), i % 4 == 1) for i in range(30)], "doc_id long, text string, held_out boolean").repartition(3)
    blocks, rounds = lm._blocks(df, RANKS), []
    n = blocks.filter("idx = -1").agg(F.sum("n")).first()[0]
    weights, asked = lm._weights, []
    monkeypatch.setattr(lm, "PART_WINDOWS", 40)
    monkeypatch.setattr(lm, "_weights", lambda drawn, n, slot, steps: asked.append((n, drawn.count(), drawn, slot)))
    lm._fit(blocks, RANKS, 8)
    assert asked[0][:2] == (n, n) and n > 400
    monkeypatch.setattr(lm, "_round", lambda rows, parts, slot, state, *steps: rounds.append([(r.part, r.key, bytes(r.data)) for r in rows.collect()]) or state)
    weights(asked[0][2], n, asked[0][3], 8)
    assert sorted(x[1:] for r in rounds[1:] for x in r) == sorted((r.key, bytes(r.data)) for r in asked[0][2].collect())
    assert {x[0] for r in rounds[1:] for x in r} == set(range(-(-n // 40))) and len(rounds[0]) > 0
    for size, times in ((3, 2), (96, 3), (1000, 11)):
        met = np.concatenate(list(attention.turns(size, times, (1, 2))))
        assert (np.bincount(met, minlength=size) >= 1).all()
    assert len(np.unique(np.concatenate(list(attention.turns(1000, 10, (1, 2)))))) == 960


def test_model_is_a_distribution_over_words():
    """Probabilities of all words of up to two letters, and of longer ones, can't exceed one."""
    model = lm.Model(RANKS, ["ab ba ab", "a b ab"], steps=30)
    words = [chr(a) for a in range(97, 123)] + [chr(a) + chr(b) for a in range(97, 123) for b in range(97, 123)]
    spelling = model.spelling(words)
    total = sum(np.exp(model.event_logs(spelling, np.array([k, len(words)]), np.array([0]))[0]) for k in range(len(words)))
    assert 0 < total <= 1.0
