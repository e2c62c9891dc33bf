"""Scalar functions on stated values, and their properties."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumine.functions import dates, links, similarity, text

AS_OF = "2024-06-01"


def each(spark, values, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i")
    return rows.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).collect()


RANGES = [
    ("Engineer Jan 2020 - Present", ("2020-01-01", None, True)), ("03/2014 to 11/2016", ("2014-03-01", "2016-11-01", False)), ("2015-18", ("2015-01-01", "2018-01-01", False)), ("May 2012", ("", "2012-05-01", False)),
    ("Sept '19 – Aug 2021", ("2019-09-01", "2021-08-01", False)), ("Expected May 2027", ("", "2027-05-01", False)), ("no date", None), ("June 2018 until now", ("2018-06-01", None, True)), ("2019", ("", "2019-01-01", False)),
]


def test_find_range(spark):
    got = each(spark, [t for t, _ in RANGES], dates.find_range("t"))
    for (t, want), r in zip(RANGES, got, strict=True):
        assert (None if r.c0 is None else (r.c0.start, r.c0.end, r.c0.current)) == want, t
    assert got[5].c0.raw == "Expected May 2027"


def test_strip_range_and_points(spark):
    got = each(spark, ["Acme Inc, Jan 2020 - Present", "Plain", "Jun 2001"], dates.strip_range("t"))
    assert [r.c0 for r in got] == ["Acme Inc", "Plain", ""]
    points = ["Aug 2022", "08/2023", "Aug '22", "2022", "13/2020", "soon"]
    assert [r.c0 for r in each(spark, points, dates.to_iso("t"))] == ["2022-08-01", "2023-08-01", "2022-08-01", "2022-01-01", "", ""]


def test_parse_period(spark):
    cases = [("Summer 2019 - Fall 2020", False, ("2019-06-01", "2020-09-01", False)), ("Q3 2021", False, ("2021-07-01", None, False)), ("Q3 2021", True, ("", "2021-07-01", False)), ("Expected May 2027", False, ("", "2027-05-01", True)),
             ("May 2012", True, ("", "2012-05-01", False)), ("May 2012", False, ("2012-05-01", None, False)), ("", False, ("", None, False)), ("ongoing", False, ("", None, True)), ("Aug 2023 - May 2027 (expected)", False, ("2023-08-01", "2027-05-01", True))]
    for t, lone, want in cases:
        got = each(spark, [t], dates.parse_period("t", AS_OF, lone))[0].c0
        assert (got.start, got.end, got.isCurrent) == want, t


@settings(max_examples=2, deadline=None)
@given(st.lists(st.tuples(st.integers(2000, 2030), st.integers(1, 12), st.integers(0, 40), st.sampled_from(["%B %Y", "%b %Y", "%m/%Y"])), min_size=100, max_size=100))
def test_ordered_ranges_come_back(spark, rows):
    from datetime import date

    texts, want = [], []
    for y, m, delta, style in rows:
        k = y * 12 + m - 1 + delta
        a, b = date(y, m, 1), date(k // 12, k % 12 + 1, 1)
        texts.append(f"{a.strftime(style)} - {b.strftime(style)}")
        want.append((a.isoformat(), b.isoformat(), False))
    got = [(r.c0.start, r.c0.end, r.c0.isCurrent) for r in each(spark, texts, dates.parse_period("t", "2099-01-01"))]
    assert got == want


@settings(max_examples=2, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=100, max_size=100))
def test_nothing_raises_or_is_made_up(spark, values):
    for r, t in zip(each(spark, values, dates.parse_period("t", AS_OF), text.cells("t"), links.urls("t"), text.redacted("t"), text.label_and_rest("t")), values, strict=True):
        year = r.c0.start[:4] or (r.c0.end or "")[:4]
        assert not year or year[2:] in t


def test_normal_forms(spark):
    r = each(spark, ["Awards & Honors  Section", "C++/Java, “Quoted”  é"], text.heading_form("t"), text.ground_form("t"), text.metric_form("t"), text.zone_form("t"))
    assert r[0].c0 == "awards and honors" and r[1].c1 == "c java quoted" and r[1].c2 == "c++/java quoted é" and r[0].c3 == "awards  honors  section"
    assert each(spark, ["ﬁne"], text.ground_form("t"))[0].c0 == "fine"


def test_lines(spark):
    r = each(spark, ["• Item one", "o Nested item", "- 5", "Skills: a: b", "Lang\tEnglish: x", "[]\tAcme\t§"], text.is_bullet("t"), text.strip_glyph("t"), text.label_and_rest("t"), text.cells("t"))
    assert [x.c0 for x in r] == [True, False, True, False, False, False] and [x.c1 for x in r][:2] == ["Item one", "Nested item"]
    assert (r[3].c2.label, r[3].c2.rest, r[3].c2.colon) == ("Skills", "a: b", True) and (r[4].c2.label, r[4].c2.rest) == ("Lang", "English: x") and r[5].c3 == ["Acme"]
    assert each(spark, ["X"], text.dehyphenated(F.lit("exam-"), F.lit("ple")), text.dehyphenated(F.lit("two"), F.lit("words")))[0] == ("example", "two words")
    assert [x.c0 for x in each(spark, ["HELLO 1", "Hello", "A", "ÉT"], text.all_caps("t"))] == [True, False, False, True]


def test_redaction(spark):
    r = each(spark, ["mongodb+srv://me:secret@host/db", "key ghp_abcdefgh123", "Bearer abcdefgh.ij", "plain"], text.redacted("t"))
    assert [x.c0 for x in r] == ["mongodb+srv://me:***@host/db", "key ghp_***", "Bearer ***", "plain"]


def test_links(spark):
    cases = [("https://www.linkedin.com/in/someone/", "linkedin"), ("linkedin.com/company/x", "skip"), ("https://github.com/someone", "github_profile"), ("https://github.com/someone/repo", "github_repo"), ("leetcode.com/u/x", "platform"), ("someone.dev", "other")]
    r = each(spark, [u for u, _ in cases], links.classify(links.clean_url("t"))["kind"], links.norm_url("t"))
    assert [x.c0 for x in r] == [k for _, k in cases] and r[0].c1 == "linkedin.com/in/someone"
    assert each(spark, ["see www.a.example/x, or github.com/y."], links.urls("t"))[0].c0 == ["https://www.a.example/x", "https://github.com/y"]


def test_jaro_winkler_equals_duckdb():
    import random

    rng = random.Random(3)
    pairs = [("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 9)))) for _ in range(800)]
    con = duckdb.connect()
    for a, b in pairs:
        if a and b:
            want = con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
            assert similarity.jaro_winkler(a, b) == pytest.approx(want, abs=1e-9), (a, b)


def test_ratios():
    assert similarity.ratio("abc", "abd") == pytest.approx(200 * 2 / 6) and similarity.token_sort_ratio("b a", "a b") == 100.0 and similarity.token_set_ratio("a b c", "a b") == 100.0
    assert similarity.partial_alignment("bcd", "abcde") == (100.0, 1, 4) and similarity.partial_ratio("hello wrld", "say hello world now") >= 90
    assert similarity.key_similarity("", None) == 1.0 and similarity.key_similarity("a", "") == 0.0


def test_repaired(spark):
    said = {"It\u00e2\u20ac\u2122s caf\u00c3\u00a9": "It\u2019s caf\u00e9", "na\u00efve \u00c3": "na\u00efve \u00c3", "plain": "plain", "": "", "\u65e5\u672c \u00c3\u00a9": "\u65e5\u672c \u00c3\u00a9", "\u00c3\u00bcber": "\u00fcber"}
    df = spark.createDataFrame([(k, v) for k, v in said.items()] + [(None, None)], "t string, want string")
    assert df.select(text.repaired("t").alias("got"), "want").filter("not (got <=> want)").count() == 0
