"""Registered queries that have an SQL twin, against DuckDB."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from partmill.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in sorted(names)) for r in got.collect()) == Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall())


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
