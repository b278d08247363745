"""Registered queries against DuckDB on the smallest scale; all of them with MULLION_ALL=1."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))
from check import NAMES, rows  # noqa: E402

from mullion import registry  # noqa: E402

QUICK = ["J1", "J3", "W1", "W3", "W6", "A18", "W9", "W18", "J4", "J5", "J9", "P5", "F3", "F20", "A7", "J16", "X23", "M1", "M4", "T2", "T5", "S12"]
PICKED = sorted(registry.oracle_sql()) if os.environ.get("MULLION_ALL") else QUICK


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", PICKED)
def test_matches_duckdb(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    cur = con.execute(registry.oracle_sql()[name])
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(want_cols)
    assert rows(df.columns, df.collect()) == rows(want_cols, want)


def test_every_query_has_a_name_and_oracles_belong_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) == 255
