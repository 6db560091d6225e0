"""Queries of this subpackage against their SQL, on the whole small tables."""

from __future__ import annotations

import duckdb
import pytest

from tests.test_queries import TABLES, rows_of
from tidemark.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_like_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    frame = queries.queries()[name](spark, SF)
    found = con.sql(queries.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(found.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(found.columns, found.fetchall())


def test_one_query_per_operator():
    numbers = [int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")]
    assert numbers == list(range(1, 14))
