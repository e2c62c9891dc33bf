"""Every query of the catalog against its SQL at the smallest scale, and the entry points."""

import os

import duckdb
import pytest

import __spark_entry__
from vellumine.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(catalog.ORACLE_SQL) >= 40


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, oracle, tmp_path, name):
    catalog.QUERIES[name](spark, DIR).write.parquet(str(tmp_path / "got"))
    oracle.execute(f"create or replace temp view got as select * from '{tmp_path}/got/*.parquet'")
    oracle.execute(f"create or replace temp table want as {catalog.ORACLE_SQL[name]}")
    columns = {t: sorted(r[0] for r in oracle.execute(f"describe {t}").fetchall()) for t in ("got", "want")}
    assert columns["got"] == columns["want"]
    names = ", ".join(f'"{c}"' for c in columns["got"])
    for a, b in (("got", "want"), ("want", "got")):
        assert not oracle.execute(f"select {names} from {a} except all select {names} from {b} limit 3").fetchall(), (a, b)


@pytest.mark.parametrize("name", ["entries_fold", "document_contacts"])
def test_without_sql(spark, name):
    assert len(catalog.QUERIES[name](spark, DIR).collect()) > 0


@pytest.mark.parametrize("name", ["interval_merge", "interval_free"])
def test_intervals_without_ends_and_of_parts(spark, oracle, tmp_path, name):
    """Missing starts and ends, quantities that are no whole numbers: as in the SQL. No two rows are alike but for ties the SQL doesn't leave open."""
    rows = "(1, 5, 2.0), (1, 5, null), (1, 9, 2.5), (1, 12, 3.5), (2, 3, null), (2, 4, 1.0), (2, null, 4.0), (3, 7, 4.5), (3, 20, 1.5), (3, 22, 0.5)"
    oracle.execute(f"copy (select k as l_suppkey, timestamp '1992-01-01' + to_days(d) as l_shipdate, q::double as l_quantity from (values {rows}) v(k, d, q)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    sql = catalog.ORACLE_SQL[name].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = oracle.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_jobs_without_dates_or_keys(spark, oracle, tmp_path):
    """Customers of whose jobs no end is known have no last month, as in the SQL. No two jobs are alike."""
    rows = "(1, 5, null), (2, null, 9), (3, 7, 40), (3, null, 50), (3, 8, null), (4, 97, null), (5, 97, 3), (5, 30, 2000), (null, 11, 70), (null, 12, null)"
    oracle.execute(f"copy (select c as o_custkey, k::bigint as o_orderkey, timestamp '1992-01-01' + to_days(d) as o_orderdate from (values {rows}) v(c, k, d)) to '{tmp_path}/orders.parquet' (format parquet)")
    sql = catalog.ORACLE_SQL["month_union_years"].replace("from orders", f"from '{tmp_path}/orders.parquet'")
    got = catalog.QUERIES["month_union_years"](spark, str(tmp_path))
    want = oracle.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and sum(r[2] is None for r in want) == 2


def test_equal_intervals_stay_in_one_island(spark):
    """Many copies of the interval that begins an island: each island is the union of its own intervals."""
    from vellumine.operators.layout import interval_islands

    spans = [(k, a, b) for k in range(50) for a, b in ((0, 2), (5, 5), (5, 5), (5, 5), (8, 9), (8, 9))]
    got = sorted(map(tuple, interval_islands(spark.createDataFrame(spans, "k int, a int, b int").repartition(7), "a", "b", "k").select("k", "a", "b", "n").collect()))
    assert got == [(k, a, b, n) for k in range(50) for a, b, n in ((0, 2, 1), (5, 5, 3), (8, 9, 2))]


def test_gaps_end_at_known_starts(spark):
    """An interval without a start stands alone after the others: no gap begins at its end."""
    from vellumine.operators.layout import interval_gaps

    spans = spark.createDataFrame([(1, 2, 4), (1, None, 0), (1, 9, 9)], "k int, a int, b int")
    assert [tuple(r) for r in interval_gaps(spans, "a", "b", 2, "k").collect()] == [(1, 4, 9)]
