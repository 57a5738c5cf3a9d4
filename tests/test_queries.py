"""Every query of the library's own operators against its SQL in DuckDB, over the smallest given tables."""

from __future__ import annotations

import importlib
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from citetrust.fixtures.oracle import oracle
from citetrust.fixtures.queries import QUERIES

SF_DIR = Path("/root/testdata/sf0.001")
ORACLE = oracle()

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="given tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry_points.queries().items()
    assert ORACLE.items() <= entry_points.oracle_sql().items()


def test_entry_points_without_the_llm_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with_none = importlib.reload(entry_points)
    assert set(with_none.queries()) == set(with_none.oracle_sql()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(entry_points)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, str(SF_DIR))
    columns = sorted(found.columns)
    rows = Counter(tuple(r) for r in found.select(*columns).collect())
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == Counter(tuple(r[i] for i in order) for r in cursor.fetchall())
    assert rows


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["revision_id", "pair_id", "p_added", "p_removed"]
