"""Every engine query against its SQL on the smallest tables, where these are present."""

import glob
import os

import pytest

from platewise.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    found = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        found.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return found


def plain(rows, order):
    return sorted(tuple("" if r[k] is None else f"{r[k]:.9g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    order = sorted(got.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == order
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert plain([r.asDict() for r in got.collect()], order) == plain(rows, order)


@pytest.mark.parametrize("name", ["leftover_ratio", "leftover_report"])
def test_leftovers_match_sql_at_odd_sizes(spark, con, tmp_path, name):
    size = "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_partkey * 7919 % 100000 ELSE p_partkey * 31 % 50 END"
    path = f"{tmp_path}/part.parquet"
    con.sql(f"COPY (SELECT range AS p_partkey, CAST({size.replace('p_partkey', 'range')} AS INT) AS p_size FROM range(8000)) TO '{path}'")
    got = QUERIES[name](spark, str(tmp_path))
    order = sorted(got.columns)
    want = con.sql(ORACLE_SQL[name].replace(" FROM part)", f" FROM '{path}')"))
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert len(rows) > 900 and plain([r.asDict() for r in got.collect()], order) == plain(rows, order)
