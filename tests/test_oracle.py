"""Every library query with SQL of its own gives what DuckDB gives for that SQL on the smallest tables."""

import importlib
import os

import duckdb
import pytest

SMALLEST = "/root/testdata/sf0.001"
MODULES = ["text_queries", "page_queries", "report_queries", "operation_queries", "rule_queries"]
SQL = {k: q for m in MODULES for k, q in importlib.import_module(f"glyphmill.plans.{m}").SQL.items()}
QUERIES = {k: f for m in MODULES for k, f in importlib.import_module(f"glyphmill.plans.{m}").QUERIES.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test data")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data), sorted(names)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    found = QUERIES[name](spark, SMALLEST)
    con = duckdb.connect()
    for f in os.listdir(SMALLEST):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SMALLEST}/{f}')")
    wanted = con.execute(SQL[name])
    assert rows(found.columns, found.collect()) == rows([d[0] for d in wanted.description], wanted.fetchall())


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
