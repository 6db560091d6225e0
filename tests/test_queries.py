"""Every registered query of the library against its SQL."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tidemark.plans import queries  # noqa: F401  registers them
from tidemark.plans.registry import QUERIES, SQL, register

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int | float) or type(x).__name__ == "Decimal":
        x = float(x)
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in rows])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    got = rows_of(frame.columns, frame.collect())
    if name not in SQL:
        assert got
        return
    found = con.sql(SQL[name])
    assert sorted(frame.columns) == sorted(found.columns)
    assert got == rows_of(found.columns, found.fetchall())


def test_names_are_unique():
    with pytest.raises(ValueError):
        register(next(iter(QUERIES)))(lambda s, d: None)


def test_payloads_are_parsed_in_one_place(spark, sf):
    """The given payloads are validated once and read from there; a filter on why they are no events does not parse them again for every place that it names them."""
    plan = QUERIES["event_payload_types"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") <= 2  # of the known payloads: one value, and no other beside it
    assert "get_json_object" not in plan
