"""Every registered query with an SQL twin gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from seenscope.catalog.oracle import ORACLE_SQL as ORACLE
from seenscope.catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    wanted = duck.execute(ORACLE[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert _rows(found.columns, found.collect()) == _rows(columns, wanted.fetchall())


def test_every_query_is_covered():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLE) <= set(entry_point.oracle_sql())


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 16
    assert sum(r["auc"] for r in rows) / len(rows) > 0.85
