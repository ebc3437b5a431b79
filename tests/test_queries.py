"""Each query against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from plumbline.operators import coverage
from plumbline.queries import ORACLE_SQL, QUERIES, lcov_report

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    try:
        return repr(round(float(v), 9))
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    relation = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(relation.columns)
    rows = lambda all_rows, names: sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in all_rows)
    expected = relation.to_arrow_table()
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows([tuple(r.values()) for r in expected.to_pylist()], expected.column_names)


def test_every_query_has_sql():
    assert set(QUERIES) - {"q_clone_groups"} == set(ORACLE_SQL)  # which tests/test_clones.py covers


def test_lcov_report_takes_the_whole_table_in_small_reports(spark, duck):
    lines = lcov_report(spark.read.parquet(f"{DATA}/lineitem.parquet"))
    got = sorted(tuple(r) for r in coverage.covered(coverage.lcov_entries(lines), ["source"]).drop("percent").collect())
    expected = duck.sql("""select 'p' || l_partkey, 'branch', count(*) filter (where l_orderkey % 2 = 1 and l_returnflag <> 'N'), count(*) filter (where l_returnflag <> 'N') from lineitem group by l_partkey
        union all select 'p' || l_partkey, 'line', count(*) filter (where l_quantity % 3 >= 1), count(*) from lineitem group by l_partkey""").fetchall()
    assert got == sorted(expected)
    hot = duck.sql("select max(n) from (select count(*) as n from lineitem group by l_orderkey)").fetchall()[0][0]
    assert max(r["count"] for r in lines.groupBy("report").count().collect()) == 4 * hot
