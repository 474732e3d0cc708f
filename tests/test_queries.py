"""Every query that has SQL gives the rows that DuckDB gives, at the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [k for m in entry.MODULES for k in m.QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(table):
    table = table.select(sorted(table.column_names))
    return table.column_names, sorted(tuple(map(str, r)) for r in zip(*(c.to_pylist() for c in table.columns)))


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_matches_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, SF).toArrow()) == rows(duck.sql(entry.oracle_sql()[name]).to_arrow_table())


def test_no_nested_loops(spark):
    """Joins in time and space keep an equi key."""
    for name in ("nearest_within_30min", "interval_all_matches", "radius_nearest_match", "cluster_single_linkage", "knn_idw"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
